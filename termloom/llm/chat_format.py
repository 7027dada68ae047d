"""Chat formatting with DataFrame functions only.

A declarative template says how a turn is marked, which roles carry loss and which
role may follow which. A finite-state machine folds over the roles of each
conversation; the turns become text segments with a loss flag each. Control strings
inside roles and texts are escaped, so the output can be read back exactly.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ESCAPE = "\\"
CHECK_TURN = "</s>[INST] ok [/INST]"


def _transitions() -> dict[tuple[str, str], str]:
    return {
        ("start", "system"): "system",
        ("start", "user"): "user",
        ("system", "user"): "user",
        ("user", "assistant"): "assistant",
        ("assistant", "user"): "user",
    }


@dataclass(frozen=True)
class Template:
    """opening + role + between + text + closing for each turn. ``control``: further
    strings that must not appear unescaped. No string may hold the escape character."""

    opening: str = "<|im_start|>"
    between: str = "<|im_sep|>"
    closing: str = "<|im_end|>"
    control: tuple[str, ...] = ("<s>", "</s>", "[INST]", "[/INST]")
    loss_roles: tuple[str, ...] = ("assistant",)
    transitions: dict[tuple[str, str], str] = field(default_factory=_transitions)
    accepting: tuple[str, ...] = ("assistant",)

    def marks(self) -> list[str]:
        marks = [self.opening, self.between, self.closing, *self.control]
        if any(len(m) < 2 or ESCAPE in m for m in marks):
            raise ValueError("a control string needs two characters and no escape character")
        return marks


def escaped(text: Column, template: Template) -> Column:
    """Double every escape character, then break each control string after its first one."""
    doubled = F.replace(text, F.lit(ESCAPE), F.lit(ESCAPE * 2))
    pattern = "|".join(rf"\Q{m[0]}\E(?=\Q{m[1:]}\E)" for m in template.marks())
    return F.regexp_replace(doubled, pattern, r"$0\\")


def unescaped(text: Column) -> Column:
    """Inverse of ``escaped``: each escape character gives way to what follows it."""
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def format_conversations(rows: DataFrame, template: Template = Template(), conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row for each conversation: ``conv_id, n_turns, valid, segments, formatted``.

    ``segments`` is an array of (text, loss) in order, ``formatted`` their
    concatenation; ``valid`` tells whether the roles follow the template's machine and
    end in an accepting state (others are formatted all the same). Turns are ordered
    by turn, ties by role and text, a null turn first; a repeated row is a turn of its
    own. Null role or text counts as empty; rows of null conversation id form one
    conversation; extra columns are ignored.
    """
    turn = F.struct(F.col(f"`{turn_col}`").alias("turn"), F.coalesce(F.col(f"`{role_col}`"), F.lit("")).alias("role"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    grouped = rows.select(F.col(f"`{conv_col}`").alias("conv"), turn.alias("t")).groupBy("conv").agg(F.sort_array(F.collect_list("t")).alias("turns"))

    moves = F.create_map(*[F.lit(x) for (state, role), to in template.transitions.items() for x in (f"{state}\n{role}", to)])
    last = F.aggregate("turns", F.lit("start"), lambda state, t: F.coalesce(F.try_element_at(moves, F.concat(state, F.lit("\n"), t["role"])), F.lit("error")))

    def segment(text: Column, loss: Column) -> Column:
        return F.struct(text.alias("text"), loss.alias("loss"))

    def marked(t: Column) -> Column:
        head = F.concat(F.lit(template.opening), escaped(t["role"], template), F.lit(template.between))
        return F.array(segment(head, F.lit(False)), segment(escaped(t["text"], template), t["role"].isin(*template.loss_roles)), segment(F.lit(template.closing), F.lit(False)))

    return grouped.select(
        F.col("conv").alias(conv_col),
        F.size("turns").cast("long").alias("n_turns"),
        last.isin(*template.accepting).alias("valid"),
        F.flatten(F.transform("turns", marked)).alias("segments"),
    ).withColumn("formatted", F.array_join(F.transform("segments", lambda s: s["text"]), ""))


def read_back(formatted: Column, template: Template = Template()) -> Column:
    """The turns (role, text) that a formatted string holds."""
    pieces = F.split(formatted, rf"\Q{template.closing}\E", -1)

    def turn(piece: Column) -> Column:
        inner = F.split(F.substring(piece, len(template.opening) + 1, 2147483647), rf"\Q{template.between}\E", 2)
        return F.struct(unescaped(inner[0]).alias("role"), unescaped(inner[1]).alias("text"))

    return F.transform(F.slice(pieces, F.lit(1), F.size(pieces) - 1), turn)


def op5_chat_format(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    check = spark.range(1).select(
        F.explode(F.array(*[F.struct(F.lit(-1).cast("long").alias("conv_id"), F.lit(i).cast("long").alias("turn"), F.lit(r).alias("role"), F.lit(CHECK_TURN).alias("text")) for i, r in enumerate(("user", "assistant"))])).alias("r")
    ).select("r.*")
    out = format_conversations(rows.unionByName(check))
    turns = F.transform(read_back(F.col("formatted")), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    loss = F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescaped(s["text"])), "")
    return (
        out.withColumn("turns", turns)
        .withColumn("loss", loss)
        .select(
            "conv_id",
            F.size("turns").cast("long").alias("n_turns"),
            F.sha2(F.array_join("turns", "").cast("binary"), 256).alias("turns_sha256"),
            F.length("loss").cast("long").alias("loss_chars"),
            F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
            F.length("formatted").cast("long").alias("formatted_chars"),
            "valid",
        )
    )


def _sql_escaped(column: str) -> str:
    out = f"replace({column}, '\\', '\\\\')"
    for m in Template().marks():
        out = f"replace({out}, '{m}', '{m[0]}\\{m[1:]}')"
    return out


_T = Template()
ORACLE = f"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '{CHECK_TURN}' UNION ALL SELECT -1, 1, 'assistant', '{CHECK_TURN}'
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum({len(_T.opening + _T.between + _T.closing)} + length({_sql_escaped('role')}) + length({_sql_escaped('text')})) AS BIGINT) AS formatted_chars,
  regexp_full_match(string_agg(role, chr(10) ORDER BY turn NULLS FIRST, role, text), '(system\\n)?user\\nassistant(\\nuser\\nassistant)*') AS valid
FROM rows GROUP BY conv_id
"""
