"""Fixed values of the term grammar: scripts, patterns, word lists.

Each pattern is written so that Java's and RE2's dialects read it alike; ``UNICODE``
is put before a Java pattern whose blanks and digits must be Unicode's.
"""

from __future__ import annotations

UNICODE = "(?U)"

# Candidate patterns of the v4 profile, each scanned on its own.
KATAKANA = "[ァ-ヶー]+"
KANJI = "[一-龯]{2,}"
MODEL_DIGIT_FIRST = "[0-9]+[A-Za-z]+[0-9A-Za-z~～\\-]*"
MODEL_LETTER_FIRST = "[A-Za-z]+[0-9]+[A-Za-z0-9~～\\-]*"
LETTERS = "[A-Za-z]+"
TWO_SCRIPTS = "[ァ-ヶー]+[一-龯]+|[一-龯]+[ァ-ヶー]+"
THREE_RUNS = "[一-龯]+[ァ-ヶー]+[一-龯]+"
V4_PATTERNS = (KATAKANA, KANJI, MODEL_DIGIT_FIRST, MODEL_LETTER_FIRST, LETTERS, TWO_SCRIPTS, THREE_RUNS)

# Candidate patterns of the semrerank and v3 profiles.
CAPITALISED = "[A-Z][A-Za-z0-9]*"
SIMPLE_PATTERNS = (KATAKANA, KANJI, CAPITALISED, TWO_SCRIPTS)

# Heading lines of the v4 profile (any case) and the terms inside them.
V4_HEADINGS = (
    "^第[０-９\\d]+[章節項]\\s+(.+)$",
    "^[０-９\\d]+\\.\\s+(.+)$",
    "^[０-９\\d]+\\.[０-９\\d]+\\s+(.+)$",
    "^\\[(.+?)\\]",
    "^【(.+?)】",
    "^Chapter\\s+\\d+[:：]\\s*(.+)$",
    "^Section\\s+\\d+[:：]\\s*(.+)$",
    "^[■□▼▲●○]\\s*(.+)$",
    "^([A-Z\\s]{5,})$",
)
V4_HEADING_TERMS = (KATAKANA, KANJI, "[0-9]+[A-Za-z]+[0-9A-Za-z~\\-]*", "[A-Za-z]+[0-9]+[A-Za-z0-9~\\-]*", "[A-Za-z]{2,}")

# Heading lines of the v3 profile (case matters); terms by SIMPLE_PATTERNS.
V3_HEADINGS = (
    "^#{1,6}\\s+(.+)$",
    "^\\d+\\.\\s+(.+)$",
    "^[一二三四五六七八九十]+[、．]\\s*(.+)$",
    "^第[一二三四五六七八九十\\d]+[章節項]\\s*(.+)$",
    "^\\[\\d+\\]\\s*(.+)$",
)

# Beginnings of garbled or deictic terms.
GARBAGE = ("アンモ$", "ニア[^ニ]", "GHG[排出]$", "[ァ-ヶー]{1,2}[燃焼料]", "本[エンジン船舶]", "この", "その", "当該")
SHORT_KATAKANA = "^[ァ-ヶー]{1,2}$"

# Nouns too common to be terms alone.
COMMON_NOUNS = (
    "エンジン", "燃料", "燃焼", "ガス", "船", "船舶",
    "使用", "開発", "供給", "輸送", "運転", "試験",
    "結果", "効果", "濃度", "出力", "負荷", "周囲",
    "混合", "全部", "商業", "熱量", "臭", "弁",
)

# Model numbers, in any case.
MODEL_NUMBERS = ("[0-9]+[A-Z]+[0-9A-Z~～\\-]*", "[A-Z]+[0-9]+[A-Z0-9~～\\-]*", "[A-Z]{2,}[\\-]?[0-9]{2,}", "[0-9]+[A-Z][\\-][0-9]+")
MODEL_NUMBER = "(?i)^(?:" + "|".join(MODEL_NUMBERS) + ")$"

# Endings that make a term look technical.
TECHNICAL_SUFFIXES = ("システム", "機関", "方式", "技術", "機構", "エンジン", "装置", "設備")

# The runs that count as components of a term, and the words of a text.
COMPONENT = "[ァ-ヶー]+|[一-龯]+|[A-Za-z0-9]+|[0-9]+"
SCRIPT_RUN = "[ァ-ヶー]+|[ぁ-ゔー]+|[一-龯]+|[A-Za-z0-9]+"

# Sentence ends of the three splits.
ENDS_PLAIN = "。"
ENDS_ALL = "[。！？\\n]+"
ENDS_COMMA = "[。！？、\\n]"

BLANKS = "\\s"

# Stopwords of the v3 profile.
STOPWORDS = (
    "こと", "もの", "ため", "場合", "とき", "ところ", "方法",
    "状態", "結果", "目的", "対象", "内容", "情報", "データ",
    "システム", "プロセス", "サービス", "ソフトウェア",
    "確認", "実施", "作成", "使用", "管理", "処理", "記録",
    "年", "月", "日", "時", "分", "秒", "件", "個", "つ",
)

# Phrases that admit a definition is not known.
UNKNOWN_PHRASES = ("定義不明", "わかりません", "不明", "特定できません")
