"""Tasks of instruction rows: flags and one primary task, all as Columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import strip, text_of

# Patterns and phrases of the tasks.
OPTION_LINE = r"(?:^|\n)\s*[\(\[]?\s*([A-D]|[1-4])\s*[\)\].:\-]\s+\S"
LETTER_ANSWER = r"(?i)^\s*[\(\[]?\s*([A-D])\s*(?:[\)\].:\-][^\n]{0,80})?\s*$"
QUESTION_START = r"(?i)^\s*(what|why|how|when|where|who|which|is|are|do|does|did|can|could|would|should|was|were)\b"
SCIENCE = r"(?i)\b(force|energy|matter|organism|planet|chemical|temperature|water|light|sound|earth|animal|plant|cell|gas|solid|liquid|ecosystem|electric|magnet|gravity|photosynthesis|biology|physics|chemistry|atom|molecule|species)\b"
PRONOUN = r"(?i)\b(he|she|it|they|him|her|them|his|hers|its|their)\b"
CODE_FENCE = r"```[\s\S]*?```|`[^`\n]+`"
CODE_HINTS = (
    r"(?i)\b(?:python|javascript|typescript|c\+\+|c#|sql|html|css|regex|bash|shell\s+script|kotlin|rust|golang|scala|"
    r"def\s+\w+\s*\(|function\s+\w+\s*\(|class\s+[A-Z]\w*\b|import\s+[\w\.]+|console\.log|print\s*\(|return\s+[\w\(\[\"\']|"
    r"write\s+(?:a\s+|the\s+)?(?:python|javascript|typescript|java|c\+\+|sql|html|css|bash|shell|regex|code|program|function|script|class|method)|"
    r"debug\s+(?:this|the)\s+code|fix\s+(?:this|the)\s+code|implement\s+(?:a|the)\s+\w+\s+(?:function|class|method))\b"
)
PHRASES = {
    "summarization": ("summarize", "summarise", "summary of", "tl;dr", "in one sentence", "in a sentence", "in a few sentences"),
    "translation": ("uebersetze", "übersetze", "traduce", "traduire", "in english:", "in german:"),
    "reasoning_math": ("step by step", "let's think", "let us think", "calculate", "compute the", "solve for", "equation", "math problem", "logic puzzle", "prove that", "derivation", "what is the value of", "how many"),
    "extraction": ("extract ", "find all ", "list all ", "identify ", "return only ", "extract the ", "as json", "in json format", "json output"),
    "classification": ("classify", "label this", "label the", "categorize", "categorise", "sentiment of", "true or false", "is this positive", "is this negative", "is the following"),
    "creative_writing": ("write a story", "write a poem", "write a song", "creative writing", "compose a poem", "compose a song", "write a dialogue", "write a fictional", "write a short story"),
    "cloze_next_word": ("fill in the blank", "next word", "predict the single word", "one word", "complete the sentence", "complete the passage", "missing word"),
    "hellaswag": ("what happens next", "best ending", "most likely ending", "continuation", "complete the story", "what would happen", "most plausible"),
}
CHAT_SOURCES = ("oasst1", "oasst", "sharegpt", "ultrachat")
CHOICE_SOURCES = ("arc", "openbookqa", "sciq", "winogrande", "hellaswag")
CLOZE_SOURCES = ("lambada_like",)
#: The ladder: the first flag that holds names the primary task.
LADDER = (
    ("bench_hellaswag_like", "hellaswag_like_mc"), ("bench_winogrande_like", "winogrande_like_mc"), ("bench_openbookqa_like", "openbookqa_like_mc"),
    ("multiple_choice", "multiple_choice"), ("bench_lambada_like", "cloze_next_word"), ("chat", "chat"), ("coding", "coding"), ("reasoning_math", "reasoning_math"),
    ("summarization", "summarization"), ("translation", "translation"), ("extraction", "extraction"), ("classification", "classification"),
    ("creative_writing", "creative_writing"), ("qa", "open_qa"), ("general_instruction", "general_instruction"),
)
FLAGS = (
    "multiple_choice", "qa", "general_instruction", "chat", "summarization", "translation", "reasoning_math", "coding", "extraction", "classification",
    "creative_writing", "cloze_next_word", "bench_hellaswag_like", "bench_winogrande_like", "bench_openbookqa_like", "bench_lambada_like",
)


def _any(c: Column, phrases: tuple[str, ...]) -> Column:
    out = c.contains(phrases[0])
    for p in phrases[1:]:
        out |= c.contains(p)
    return out


def has_options(text: Column) -> Column:
    """Whether two different letters or two different numbers label lines."""
    seen = F.array_distinct(F.regexp_extract_all(text, F.lit(OPTION_LINE), F.lit(1)))
    return F.lower(text).contains("multiple choice") | (F.size(F.filter(seen, lambda x: x.rlike("[A-D]"))) >= 2) | (F.size(F.filter(seen, lambda x: x.rlike("[1-4]"))) >= 2)


def words_of(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"(?U)\b\w+\b"))


def classify(df: DataFrame) -> DataFrame:
    """``df`` (instruction, input, output, source) with the flags and ``primary_task``.

    Null fields are empty. The fields are stripped in one projection and the
    flags are computed in a second one, so that no expression is expanded twice.
    """
    base = df.withColumns({"_i": strip(text_of("instruction")), "_x": strip(text_of("input")), "_o": strip(text_of("output")), "_s": F.lower(strip(text_of("source")))})
    base = base.withColumn("_p", strip(F.concat("_i", F.lit("\n\n"), "_x")))
    base = base.withColumns({"_l": F.lower("_p"), "_xl": F.lower("_x")})
    p, low, s = F.col("_p"), F.col("_l"), F.col("_s")
    first = base.withColumns(
        {
            "multiple_choice": s.isin(*CHOICE_SOURCES) | has_options(p) | ((F.col("_o") != "") & (F.length("_o") <= 120) & F.col("_o").rlike(LETTER_ANSWER)),
            "qa": p.contains("?") | F.col("_i").rlike(QUESTION_START),
            "chat": F.col("_xl").contains("previous conversation:") | (F.col("_xl").contains("user:") & F.col("_xl").contains("assistant:")) | s.isin(*CHAT_SOURCES),
            "summarization": _any(low, PHRASES["summarization"]),
            "translation": low.rlike(r"\btranslat\w+\b") | _any(low, PHRASES["translation"]),
            "reasoning_math": _any(low, PHRASES["reasoning_math"]),
            "coding": p.rlike(CODE_FENCE) | p.rlike(CODE_HINTS),
            "extraction": _any(low, PHRASES["extraction"]),
            "classification": _any(low, PHRASES["classification"]),
            "creative_writing": _any(low, PHRASES["creative_writing"]),
            "cloze_next_word": s.isin(*CLOZE_SOURCES) | _any(low, PHRASES["cloze_next_word"]) | p.contains("___") | p.contains(" _ "),
        }
    )
    mc = F.col("multiple_choice")
    second = first.withColumns(
        {
            "bench_hellaswag_like": (s == "hellaswag") | (mc & _any(low, PHRASES["hellaswag"])),
            "bench_winogrande_like": (s == "winogrande") | (mc & (low.contains("refers to") | ((p.contains("___") | low.contains("blank")) & p.rlike(PRONOUN)))),
            "bench_lambada_like": F.col("cloze_next_word") | low.contains("next word") | ((words_of(F.col("_x")) >= 60) & (words_of(F.col("_o")) <= 2) & ~mc),
        }
    )
    third = second.withColumn(
        "bench_openbookqa_like",
        s.isin("arc", "openbookqa", "sciq") | (mc & (F.col("qa") | p.rlike(SCIENCE)) & ~F.col("bench_hellaswag_like") & ~F.col("bench_winogrande_like")),
    )
    specific = F.lit(False)
    for name in ("multiple_choice", "qa", "chat", "summarization", "translation", "reasoning_math", "coding", "extraction", "classification", "creative_writing", "cloze_next_word"):
        specific |= F.col(name)
    fourth = third.withColumn("general_instruction", (F.col("_i") != "") & ~specific)
    task = F.lit("unknown")
    for flag, name in reversed(LADDER):
        task = F.when(F.col(flag), name).otherwise(task)
    return fourth.withColumn("primary_task", task).drop("_i", "_x", "_o", "_s", "_p", "_l", "_xl")
