"""Queries over the corpus: cleaning, filters, duplicates, decontamination,
samples, packing, and the profile of the texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import parsing as P
from ..functions import text as T
from ..operators import decontam, dedup, packing, sampling
from ..session import checkpoint_dir
from ..sources.tables import spread, table

QUERIES: dict = {}
SQL: dict[str, str] = {}

# the same classes in RE2
_S = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_NS = _S.replace("[", "[^", 1)
_WORDS = f"list_filter(regexp_split_to_array(lower(coalesce(text,'')), '{_S}+'), lambda x: x <> '')"


#: Unicode's letters, marks, digits and joining marks, without brackets.
_WC = r"\p{L}\p{Nl}\p{M}\p{Nd}\p{Pc}\x{200c}\x{200d}"


def re2(pattern: str) -> str:
    """A pattern of the JVM with Unicode's classes (flag U) for RE2, quoted for SQL."""
    flags = {"(?mdU)": "(?m)", "(?iU)": "(?i)", "(?imdU)": "(?im)", "(?isU)": "(?is)", "(?U)": ""}
    for jvm, own in flags.items():
        pattern = pattern.replace(jvm, own)
    out, inside, k = [], False, 0
    while k < len(pattern):
        two = pattern[k : k + 2]
        if two[:1] == "\\":
            swap = {"\\s": _S[1:-1] if inside else _S, "\\S": _NS, "\\w": _WC if inside else f"[{_WC}]", "\\d": r"\p{Nd}"}
            out.append(swap.get(two, two))
            k += 2
            continue
        inside = {"[": True, "]": False}.get(two[:1], inside)
        out.append(two[:1])
        k += 1
    return "".join(out).replace("'", "''")


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


def docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents")


def texts(spark: SparkSession, d: str, *more: str) -> DataFrame:
    """Ids and texts for work that is heavy per row, on all cores."""
    return spread(docs(spark, d).select("doc_id", "text", *more))


def _brief(df: DataFrame, c: Column) -> DataFrame:
    """The id, digest and length of a computed text."""
    return df.select("doc_id", c.alias("t")).select("doc_id", F.md5("t").alias("text_md5"), F.length("t").cast("long").alias("n_chars"))


def _brief_sql(expr: str) -> str:
    return f"SELECT doc_id, md5(t) AS text_md5, length(t) AS n_chars FROM (SELECT doc_id, {expr} AS t FROM documents)"


def _replaced(pattern: str, by: str = "", flags: str = "") -> str:
    return f"regexp_replace(coalesce(text,''), '{pattern.replace(chr(39), chr(39) * 2)}', '{by}', 'g{flags}')"


def _cleaner(name: str, column, sql: str | None) -> None:
    query(name, sql)(lambda spark, d: _brief(texts(spark, d), column(T.text_of("text"))))


_JUNK_SQL = "translate(coalesce(text,''), chr(65533)||chr(65279)||chr(8203)||chr(8204)||chr(8205)||chr(173)||chr(65534), '')"
_cleaner("clean_junk_chars", T.drop_junk, _brief_sql(_JUNK_SQL))
_cleaner("strip_urls", lambda c: F.regexp_replace(c, "(?U)" + T.URL, ""), _brief_sql(_replaced(rf"https?://{_NS}+|www\.{_NS}+")))
_cleaner("strip_html", lambda c: F.regexp_replace(c, T.HTML, ""), _brief_sql(_replaced(T.HTML)))
_cleaner("strip_fenced_code", lambda c: F.regexp_replace(c, T.FENCED_CODE, ""), _brief_sql(_replaced(T.FENCED_CODE)))
_cleaner("strip_indented_code", lambda c: F.regexp_replace(c, "(?U)" + T.INDENTED_CODE, ""), _brief_sql(_replaced(re2("(?U)" + T.INDENTED_CODE))))
_cleaner("strip_code_lines", lambda c: F.regexp_replace(c, T.unretreating(T.CODE_LINE), ""), _brief_sql(_replaced(re2(T.CODE_LINE).replace("''", "'"))))
_cleaner("strip_inline_code", lambda c: F.regexp_replace(c, T.INLINE_CODE, ""), _brief_sql(_replaced(re2(T.INLINE_CODE).replace("''", "'"))))
_cleaner("strip_latex", lambda c: F.regexp_replace(c, T.LATEX, ""), _brief_sql(_replaced(T.LATEX)))
_MATH_RE2 = T.MATH.replace("(?mdU)", "(?m)").replace(r"\s", _S)
_cleaner("strip_math_expr", lambda c: F.regexp_replace(c, T.MATH, " "), _brief_sql(_replaced(_MATH_RE2, " ")))
_cleaner("collapse_whitespace", lambda c: T.strip(T.collapse(c)), _brief_sql(f"regexp_replace(regexp_replace(regexp_replace(coalesce(text,''), '\\n{{3,}}', chr(10)||chr(10), 'g'), '[ \\t]{{2,}}', ' ', 'g'), '^{_S}+|{_S}+$', '', 'g')"))
_WIKI_SQL = "coalesce(text,'')"
for _p in T.WIKI:
    _WIKI_SQL = f"regexp_replace({_WIKI_SQL}, '{_p}', '', 'g')"
_cleaner("wiki_markup_clean", T.clean_wikipedia, _brief_sql(_WIKI_SQL))
_cleaner("nfc_normalise", T.nfc, _brief_sql("nfc_normalize(coalesce(text,''))"))
_PREFIX_SQL = "CASE " + " ".join(f"WHEN starts_with(text, '{p}') THEN regexp_replace(substr(text, {len(p) + 1}), '^{_S}+', '')" for p in T.BOILERPLATE_PREFIXES) + " ELSE coalesce(text,'') END"
_cleaner("boilerplate_prefix", T.drop_prefix, _brief_sql(_PREFIX_SQL))


def _chain(c: str) -> str:
    """``clean_text`` of a field in SQL."""
    for pattern, by in ((T.URL, ""), (T.HTML, ""), (T.FENCED_CODE, ""), ("(?U)" + T.INDENTED_CODE, ""), (T.CODE_LINE, ""), (T.INLINE_CODE, ""), (T.LATEX, ""), (T.MATH, " ")):
        c = f"regexp_replace({c}, '{re2(pattern)}', '{by}', 'g')"
    prefix = f"regexp_replace({c}, '^(?:{'|'.join(T.BOILERPLATE_PREFIXES)}){_S}*', '')"
    return f"regexp_replace(regexp_replace(regexp_replace({prefix}, '\\n{{3,}}', chr(10)||chr(10), 'g'), '[ \\t]{{2,}}', ' ', 'g'), '^{_S}+|{_S}+$', '', 'g')"


def clean_sql(c: str) -> str:
    return _chain("translate(nfc_normalize(coalesce(" + c + ",'')), chr(65533)||chr(65279)||chr(8203)||chr(8204)||chr(8205)||chr(173)||chr(65534), '')")


@query("clean_text_full", _brief_sql(clean_sql("text")))
def clean_text_full(spark, d):
    return _brief(texts(spark, d), T.clean_text("text"))


@query("clean_text_prose")
def clean_text_prose(spark, d):
    return _brief(texts(spark, d), T.clean_text("text", strip_code_and_math=False))


SQL["clean_text_prose"] = _brief_sql(
    "regexp_replace(regexp_replace("
    + _PREFIX_SQL.replace("coalesce(text,'')", "z").replace("text", "z")
    + f", '\\n{{3,}}', chr(10)||chr(10), 'g'), '^{_S}+|{_S}+$', '', 'g')"
).replace("FROM documents)", f"FROM (SELECT doc_id, regexp_replace(translate(nfc_normalize(coalesce(text,'')), chr(65533)||chr(65279)||chr(8203)||chr(8204)||chr(8205)||chr(173)||chr(65534), ''), 'https?://{_NS}+|www\\.{_NS}+', '', 'g') AS z FROM documents))")

# --------------------------------------------------------------- predicates

MIN_CHARS, MIN_WIKI = 50, 200


def long_enough(least: int = MIN_CHARS) -> Column:
    wiki = F.coalesce(F.col("source") == "wikipedia", F.lit(False))
    return F.length(T.text_of("text")) >= F.when(wiki, max(least, MIN_WIKI)).otherwise(least)


@query("min_length", "SELECT doc_id, length(text) AS n FROM documents WHERE length(coalesce(text,'')) >= 50")
def min_length(spark, d):
    return docs(spark, d).filter(F.length(T.text_of("text")) >= MIN_CHARS).select("doc_id", F.length("text").cast("long").alias("n"))


@query("min_length_by_source", "SELECT doc_id, source FROM documents WHERE length(coalesce(text,'')) >= CASE WHEN source='wikipedia' THEN 200 ELSE 50 END")
def min_length_by_source(spark, d):
    return docs(spark, d).filter(long_enough()).select("doc_id", "source")


_STOP_SQL = "[" + ",".join(f"'{w}'" for w in T.ENGLISH_STOPWORDS) + "]"
_ENGLISH_SQL = (
    "SELECT doc_id, lang, (n >= 5 AND ascii > 0.85 AND hits >= 0.12 * n) AS english FROM (SELECT doc_id, lang, len(w) AS n, len(list_filter(w, lambda x: list_contains(" + _STOP_SQL + ", x))) AS hits, "
    "length(regexp_replace(s, '[^\\x00-\\x7F]', '', 'g')) / greatest(length(s), 1) AS ascii FROM (SELECT doc_id, lang, s, regexp_extract_all(lower(s), '[a-z'']+') AS w FROM "
    "(SELECT doc_id, lang, replace(substr(coalesce(text,''), 1, 800), chr(10), ' ') AS s FROM documents)))"
)


@query("english_heuristic", _ENGLISH_SQL)
def english_heuristic(spark, d):
    return texts(spark, d, "lang").select("doc_id", "lang", T.is_english("text").alias("english"))


def _has_code(c: str) -> str:
    return f"(regexp_matches(coalesce({c},''), '{re2(T.HTML_MARKUP)}') OR regexp_matches(coalesce({c},''), '{re2(T.CODE_MARKERS)}'))"


@query("has_code_or_markup", f"SELECT doc_id, {_has_code('text')} AS hit FROM documents")
def has_code_or_markup(spark, d):
    return texts(spark, d).select("doc_id", T.has_code_or_markup("text").alias("hit"))


def _has_math(c: str) -> str:
    return f"(regexp_matches(coalesce({c},''), '{re2(T.LATEX)}') OR regexp_matches(coalesce({c},''), '{re2(T.MATH)}'))"


@query("has_math_content", f"SELECT doc_id, {_has_math('text')} AS hit FROM documents")
def has_math_content(spark, d):
    return texts(spark, d).select("doc_id", T.has_math_content("text").alias("hit"))


_TOPICS = " OR ".join(f"regexp_matches(coalesce(instruction,''), '{re2(x)}')" for x in (T.CODE_TOPIC, T.MATH_TOPIC))


@query("code_or_math_task", f"SELECT row_id, ({_TOPICS} OR {_has_code('instruction')} OR {_has_math('instruction')}) AS hit FROM sft_rows")
def code_or_math_task(spark, d):
    return table(spark, d, "sft_rows").select("row_id", T.is_code_or_math_task("instruction").alias("hit"))


# -------------------------------------------------------------- duplicates


@query("exact_dedup", "SELECT min(doc_id) AS doc_id FROM documents GROUP BY text")
def exact_dedup(spark, d):
    return dedup.exact(docs(spark, d)).select("doc_id")


@query("duplicate_rate", "SELECT count(*) AS n, count(DISTINCT text) + CASE WHEN count(*) > count(text) THEN 1 ELSE 0 END AS n_distinct FROM documents")
def duplicate_rate(spark, d):
    by = docs(spark, d).groupBy(F.md5(F.coalesce("text", F.lit("\x00null"))).alias("h")).count()
    return by.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("n_distinct"))


@query("duplicate_flags", "SELECT doc_id, count(*) OVER w > 1 AS duplicated, min(doc_id) OVER w AS first FROM documents WINDOW w AS (PARTITION BY coalesce(text, chr(1)))")
def duplicate_flags(spark, d):
    return dedup.flags(docs(spark, d))


@query("duplicate_groups", "SELECT md5(text) AS text_md5, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY text HAVING count(*) > 1")
def duplicate_groups(spark, d):
    return dedup.groups(docs(spark, d))


PRIORITY = ("wikipedia", "bookcorpus", "fineweb_edu", "openwebtext", "fineweb", "c4")
_RANK_SQL = "CASE " + " ".join(f"WHEN source='{p}' THEN '0{i:06d}'" for i, p in enumerate(PRIORITY, 1)) + " WHEN source IS NULL THEN '2' ELSE '1'||source END"


@query("cross_source_dedup", f"SELECT doc_id, source FROM (SELECT doc_id, source, {_RANK_SQL} AS r, min({_RANK_SQL}) OVER (PARTITION BY coalesce(text, chr(1))) AS best FROM documents) WHERE r = best")
def cross_source_dedup(spark, d):
    return dedup.cross_source(docs(spark, d), PRIORITY).select("doc_id", "source")


@query("minhash_near_dup")
def minhash_near_dup(spark, d):
    return dedup.minhash_keep(docs(spark, d))


# --------------------------------------------------------- decontamination

_GRAMS = "SELECT DISTINCT array_to_string(w[i:i+12], ' ') AS g FROM (SELECT w, unnest(range(1, len(w)-11)) AS i FROM (SELECT list_filter(regexp_split_to_array(lower(text), '" + _S + "+'), lambda x: x <> '') AS w FROM eval_items) WHERE len(w) >= 13)"
_DOC_GRAMS = f"SELECT doc_id, array_to_string(w[i:i+12], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w)-11)) AS i FROM (SELECT doc_id, {_WORDS} AS w FROM documents) WHERE len(w) >= 13)"
_HITS = f"SELECT doc_id, count(*) AS hits FROM ({_DOC_GRAMS}) WHERE g IN ({_GRAMS}) GROUP BY doc_id"


def hits(spark, d):
    return decontam.ngram_hits(docs(spark, d), table(spark, d, "eval_items"))


@query("ngram_index", f"SELECT md5(g) AS gram FROM ({_GRAMS})")
def ngram_index(spark, d):
    return decontam.ngram_index(table(spark, d, "eval_items"))


@query("decontam_count", _HITS)
def decontam_count(spark, d):
    return hits(spark, d)


@query("decontam_13gram", f"SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM ({_HITS}))")
def decontam_13gram(spark, d):
    return decontam.remove_hit(docs(spark, d), hits(spark, d)).select("doc_id")


@query("decontam_threshold", f"SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM ({_HITS}) WHERE hits > 10)")
def decontam_threshold(spark, d):
    return decontam.remove_hit(docs(spark, d), hits(spark, d), threshold=10).select("doc_id")


_ABBR = ", ".join(f"'{x}'" for x in P.ABBREVIATIONS)


def sentences_sql(source: str, key: str) -> str:
    """(key, s): the sentences of ``text`` in ``source``. Every place that could
    be a cut is marked, and those after an abbreviation or a number are closed again."""
    body = "string_split(p[%s], chr(2))[-1]"
    last = body % "j - 1"
    open_ = f"rtrim(regexp_extract({last}, '{_NS}+$'), '.!?') IN ({_ABBR}) OR regexp_matches({last}, '\\p{{Nd}}\\.$')"
    glued = f"list_transform(range(1, len(p) + 1), lambda j: CASE WHEN j = 1 THEN p[1] WHEN {open_} THEN string_split(p[j], chr(2))[1] || string_split(p[j], chr(2))[2] ELSE chr(1) || string_split(p[j], chr(2))[2] END)"
    marked = f"string_split(regexp_replace(coalesce(text,''), '([.!?])({_S}+)([A-Z])', '\\1' || chr(1) || '\\2' || chr(2) || '\\3', 'g'), chr(1))"
    return f"SELECT {key}, list_filter(string_split(array_to_string({glued}, ''), chr(1)), lambda x: x <> '') AS s FROM (SELECT {key}, {marked} AS p FROM {source})"


@query("sentence_split", f"SELECT doc_id, len(s)::INT AS n, md5(array_to_string(s, '|')) AS s_md5 FROM ({sentences_sql('documents', 'doc_id')})")
def sentence_split(spark, d):
    return texts(spark, d).select("doc_id", P.sentences("text").alias("s")).select("doc_id", F.size("s").alias("n"), F.md5(F.array_join("s", "|")).alias("s_md5"))


def _squeezed(c: str) -> str:
    return f"array_to_string(list_filter(regexp_split_to_array(lower({c}), '{_S}+'), lambda x: x <> ''), ' ')"


_BLOCKED = f"SELECT DISTINCT {_squeezed('x')} AS b FROM (SELECT unnest(s) AS x FROM ({sentences_sql('eval_items', 'item_id')})) WHERE length({_squeezed('x')}) >= 10"


@query("sentence_hash_set", f"SELECT md5(b) AS h FROM ({_BLOCKED})")
def sentence_hash_set(spark, d):
    return decontam.sentence_hashes(table(spark, d, "eval_items"))


@query("sentence_overlap_removal", f"WITH b AS ({_BLOCKED}), s AS (SELECT doc_id, unnest(s) AS x, generate_subscripts(s, 1) AS k FROM ({sentences_sql('documents', 'doc_id')})), t AS (SELECT doc_id, string_agg(x, ' ' ORDER BY k) AS t FROM s WHERE {_squeezed('x')} NOT IN (SELECT b FROM b) GROUP BY doc_id) SELECT d.doc_id, CASE WHEN text IS NOT NULL THEN md5(coalesce(t, '')) END AS text_md5, CASE WHEN text IS NOT NULL THEN length(coalesce(t, '')) END AS n_chars FROM documents d LEFT JOIN t USING (doc_id)")
def sentence_overlap_removal(spark, d):
    blocked = decontam.sentence_hashes(table(spark, d, "eval_items"))
    return _brief(decontam.remove_sentences(texts(spark, d), blocked), F.col("text"))


# ----------------------------------------------------- samples and budgets

_KEY = "md5('42|' || coalesce(doc_id::VARCHAR, ''))"
_KEY_R = "md5('42|' || coalesce(row_id::VARCHAR, ''))"


@query("seeded_take", f"SELECT doc_id, source FROM documents ORDER BY {_KEY}, doc_id LIMIT 100")
def seeded_take(spark, d):
    return sampling.take(docs(spark, d), 100).select("doc_id", "source")


@query("ingest_sample", f"SELECT doc_id FROM (SELECT * FROM documents ORDER BY {_KEY}, doc_id LIMIT 500) WHERE text IS NOT NULL AND text <> ''")
def ingest_sample(spark, d):
    """Take first, then drop empty texts, in that order."""
    return sampling.take(docs(spark, d), 500).filter("text is not null and text <> ''").select("doc_id")


@query("ratio_budget", "SELECT name, floor(ratio * 1000000)::BIGINT AS target_tokens FROM source_configs")
def ratio_budget(spark, d):
    return sampling.allocate(table(spark, d, "source_configs"), 1_000_000).select("name", "target_tokens")


@query("doc_count_estimate", "SELECT name, greatest(1, floor(target_tokens * 4.0 * 1.10 / CASE name WHEN 'wikipedia' THEN 8000 WHEN 'bookcorpus' THEN 5000 WHEN 'fineweb' THEN 2500 WHEN 'fineweb_edu' THEN 2500 ELSE 2000 END))::BIGINT AS n_docs FROM source_plans")
def doc_count_estimate(spark, d):
    return sampling.document_estimate(table(spark, d, "source_plans")).select("name", "n_docs")


@query("split_train_val", f"SELECT doc_id, CASE WHEN rn > n - greatest(1, floor(n * 0.05)) THEN 'val' ELSE 'train' END AS split FROM (SELECT doc_id, row_number() OVER (ORDER BY {_KEY}, doc_id) AS rn, count(*) OVER () AS n FROM documents)")
def split_train_val(spark, d):
    return sampling.split_corpus(docs(spark, d).select("doc_id")).select("doc_id", "split")


@query("split_per_source", f"SELECT row_id, CASE WHEN rn <= CASE WHEN n > 1 THEN least(greatest(1, floor(n * 0.05)), n - 1) ELSE 1 END THEN 'val' ELSE 'train' END AS split FROM (SELECT row_id, row_number() OVER (PARTITION BY source ORDER BY {_KEY_R}, row_id) AS rn, count(*) OVER (PARTITION BY source) AS n FROM sft_rows)")
def split_per_source(spark, d):
    return sampling.split_groups(table(spark, d, "sft_rows").select("row_id", "source")).select("row_id", "split")


WEIGHTS = {"alpaca": 0.5, "dolly": 1.0, "oasst1": 2.5}
_W = "CASE source WHEN 'alpaca' THEN 0.5 WHEN 'oasst1' THEN 2.5 ELSE 1.0 END"


@query("dataset_weighting", f"SELECT row_id, unnest(range(1, c + 1)) AS copy FROM (SELECT row_id, (t // n + CASE WHEN rn <= t % n THEN 1 ELSE 0 END)::BIGINT AS c FROM (SELECT row_id, rn, n, greatest(1, round_even(n * {_W}, 0))::BIGINT AS t FROM (SELECT row_id, source, row_number() OVER (PARTITION BY source ORDER BY {_KEY_R}, row_id) AS rn, count(*) OVER (PARTITION BY source) AS n FROM sft_rows)))")
def dataset_weighting(spark, d):
    return sampling.weight_copies(table(spark, d, "sft_rows").select("row_id", "source"), WEIGHTS).select("row_id", F.col("copy").cast("long").alias("copy"))


@query("per_source_cap", f"SELECT row_id FROM (SELECT row_id, row_number() OVER (PARTITION BY source ORDER BY {_KEY_R}, row_id) AS rn FROM sft_rows) WHERE rn <= 50")
def per_source_cap(spark, d):
    return sampling.cap(table(spark, d, "sft_rows").select("row_id", "source"), 50).select("row_id")


# ------------------------------------------------------------------ packing


def hashed_ids(c) -> Column:
    """The dependency-free tokenizer: an id a word, from its digest."""
    return F.transform(T.split_words(c), lambda w: (F.conv(F.substring(F.md5(w), 1, 6), 16, 10).cast("long") % 50_000).cast("int"))


_IDS = f"list_transform({_WORDS}, lambda x: ('0x' || substr(md5(x), 1, 6))::BIGINT % 50000)"


@query("token_offsets", f"SELECT doc_id, n_tokens, coalesce(sum(n_tokens) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS token_offset FROM (SELECT doc_id, len({_WORDS}) + 1 AS n_tokens FROM documents)")
def token_offsets(spark, d):
    sized = texts(spark, d).select("doc_id", (F.size(T.split_words("text")) + 1).cast("long").alias("n_tokens"))
    return packing.offsets(sized)


_STREAM = f"SELECT row_number() OVER (ORDER BY doc_id, k) - 1 AS pos, id FROM (SELECT doc_id, unnest(range(1, len(ids) + 1)) AS k, unnest(ids) AS id FROM (SELECT doc_id, list_append({_IDS}, 50256) AS ids FROM documents))"
_CHUNKS = f"SELECT chunk_id, list(id ORDER BY pos) AS ids FROM (SELECT pos, id, unnest(CASE WHEN pos % 128 = 0 AND pos > 0 THEN [pos // 128 - 1, pos // 128] ELSE [pos // 128] END) AS chunk_id FROM ({_STREAM})) GROUP BY chunk_id HAVING count(*) = 129"


def packed(spark, d):
    ids = texts(spark, d).select("doc_id", hashed_ids("text").alias("ids"))
    return packing.pack(ids.withColumn("ids", packing.with_eos("ids")), 128)


@query("pack_chunks", f"SELECT chunk_id::BIGINT AS chunk_id, md5(array_to_string(ids[1:128], ',')) AS input_md5 FROM ({_CHUNKS})")
def pack_chunks(spark, d):
    return packed(spark, d).select("chunk_id", F.md5(F.array_join(F.col("input_ids").cast("array<string>"), ",")).alias("input_md5"))


@query("shift_targets", f"SELECT chunk_id::BIGINT AS chunk_id, ids[2] AS first_target, ids[129] AS last_target, list_sum(ids[2:129])::BIGINT AS total FROM ({_CHUNKS})")
def shift_targets(spark, d):
    total = F.aggregate("target_ids", F.lit(0).cast("long"), lambda a, x: a + x)
    return packed(spark, d).select("chunk_id", F.element_at("target_ids", 1).cast("long").alias("first_target"), F.element_at("target_ids", -1).cast("long").alias("last_target"), total.alias("total"))


@query("probe_windows", f"SELECT k, ('0x' || substr(md5('42|' || k), 1, 8))::BIGINT % (n - 128 - 1) AS start FROM range(0, 200) t(k), (SELECT sum(len({_WORDS}) + 1)::BIGINT AS n FROM documents)")
def probe_windows(spark, d):
    total = texts(spark, d).agg(F.sum(F.size(T.split_words("text")) + 1).alias("n"))
    return sampling.probe_windows(spark, 200, F.col("n"), total, 128)


# ------------------------------------------------------------------ profile


PERCENTS = (1, 5, 25, 50, 75, 95, 99)


@query("length_summary", "SELECT " + ", ".join(f"avg({m}) AS {m}_mean, stddev_pop({m}) AS {m}_std, " + ", ".join(f"quantile_cont({m}, {p / 100}) AS {m}_p{p}" for p in (1, 5, 25, 50, 75, 95, 99)) for m in ("chars", "words", "sentences")) + f" FROM (SELECT length(t)::DOUBLE AS chars, len(list_filter(regexp_split_to_array(t, '{_S}+'), lambda x: x <> ''))::DOUBLE AS words, len(list_filter(regexp_split_to_array(t, '[.!?]+'), lambda x: regexp_replace(x, '^{_S}+|{_S}+$', '', 'g') <> ''))::DOUBLE AS sentences FROM (SELECT coalesce(text,'') AS t FROM documents))")
def length_summary(spark, d):
    t = T.text_of("text")
    sized = texts(spark, d).select(
        F.length(t).cast("double").alias("chars"),
        F.size(F.filter(F.split(t, T.WS + "+"), lambda w: w != "")).cast("double").alias("words"),
        F.size(F.filter(F.split(t, "[.!?]+"), lambda w: T.strip(w) != "")).cast("double").alias("sentences"),
    )
    aggs = []
    for m in ("chars", "words", "sentences"):
        aggs += [F.avg(m).alias(f"{m}_mean"), F.stddev_pop(m).alias(f"{m}_std")]
        # one buffer for all fractions of a measure
        aggs.append(F.percentile(m, F.array(*[F.lit(p / 100) for p in PERCENTS])).alias(f"{m}_p"))
    one = sized.agg(*aggs)
    names = [f"{m}_p{p}" for m in ("chars", "words", "sentences") for p in PERCENTS]
    return one.select("*", *[F.col(f"{n.split('_p')[0]}_p")[PERCENTS.index(int(n.split("_p")[1]))].alias(n) for n in names]).drop("chars_p", "words_p", "sentences_p")


# Phrases, flags and characters of the profile.
BOILERPLATE = ("cookie", "privacy policy", "terms of service", "subscribe", "sign up", "log in", "all rights reserved", "copyright", "click here", "read more", "advertisement")


def signals(df: DataFrame) -> DataFrame:
    t, low = T.text_of("text"), F.lower(T.text_of("text"))
    n = F.greatest(F.length(t), F.lit(1))
    hits_ = F.lit(0)
    for p in BOILERPLATE:
        hits_ += low.contains(p).cast("int")
    head = F.array_distinct(F.slice(T.split_words("text"), 1, 200))
    stop = F.array(*[F.lit(w) for w in T.ENGLISH_STOPWORDS])
    base = df.select(
        "doc_id",
        F.length(t).cast("long").alias("n_chars"),
        (F.length(F.array_join(F.regexp_extract_all(t, F.lit(r"(?U)https?://\S+"), F.lit(0)), "")) / n).alias("url_density"),
        F.regexp_count(t, F.lit(T.HTML)).cast("long").alias("html_tags"),
        hits_.cast("long").alias("boilerplate"),
        ((F.length(t) - F.length(F.regexp_replace(t, r"[^\x00-\x7F]", ""))) / n).alias("non_ascii"),
        head.alias("_h"),
    )
    return base.withColumn("stopword_overlap", F.when(F.size("_h") > 0, F.size(F.array_intersect("_h", stop)) / F.size("_h")).otherwise(0.0)).drop("_h")


_SIGNALS = (
    "SELECT doc_id, length(t) AS n_chars, length(array_to_string(regexp_extract_all(t, 'https?://" + _NS + "+'), '')) / greatest(length(t), 1) AS url_density, len(regexp_extract_all(t, '<[^>]+>')) AS html_tags, "
    + " + ".join(f"contains(lower(t), '{p}')::BIGINT" for p in BOILERPLATE)
    + " AS boilerplate, (length(t) - length(regexp_replace(t, '[^\\x00-\\x7F]', '', 'g'))) / greatest(length(t), 1) AS non_ascii, "
    "CASE WHEN len(h) > 0 THEN len(list_filter(h, lambda x: list_contains(" + _STOP_SQL + ", x))) / len(h) ELSE 0.0 END AS stopword_overlap "
    "FROM (SELECT doc_id, coalesce(text,'') AS t, list_distinct((" + _WORDS + ")[1:200]) AS h FROM documents)"
)


@query("quality_signals", _SIGNALS)
def quality_signals(spark, d):
    return signals(texts(spark, d))


FLAGS = {
    "url_density_over_10": "url_density > 0.10", "has_html": "html_tags > 0", "html_over_10": "html_tags > 10", "boilerplate_3": "boilerplate >= 3",
    "non_ascii_over_5": "non_ascii > 0.05", "low_stopwords": "stopword_overlap < 0.10", "short_50": "n_chars < 50", "short_200": "n_chars < 200",
}


@query("quality_flags", " UNION ALL ".join(f"SELECT '{k}' AS flag, count(*) FILTER ({v}) AS n, 100.0 * count(*) FILTER ({v}) / count(*) AS pct FROM s" for k, v in FLAGS.items()).join([f"WITH s AS ({_SIGNALS}) ", ""]))
def quality_flags(spark, d):
    one = signals(texts(spark, d)).agg(F.count(F.lit(1)).alias("total"), *[F.count_if(F.expr(v)).alias(k) for k, v in FLAGS.items()])
    stacked = ", ".join(f"'{k}', {k}" for k in FLAGS)
    return one.selectExpr("total", f"stack({len(FLAGS)}, {stacked}) as (flag, n)").select("flag", "n", F.try_divide(F.lit(100.0) * F.col("n"), F.col("total")).alias("pct"))


@query("low_english_recheck", "SELECT CASE WHEN f < 0.1 THEN 'low' WHEN f < 0.3 THEN 'middle' ELSE 'high' END AS bucket, count(*) AS n FROM (SELECT len(list_filter(w, lambda x: list_contains(" + _STOP_SQL + ", x))) / greatest(len(w), 1) AS f FROM (SELECT list_transform(" + _WORDS + ", lambda x: regexp_replace(x, '^[.,!?;:()\"'']+|[.,!?;:()\"'']+$', '', 'g')) AS w FROM documents WHERE doc_id IN (SELECT doc_id FROM (" + _SIGNALS + ") WHERE stopword_overlap < 0.10))) GROUP BY 1")
def low_english_recheck(spark, d):
    flagged = signals(texts(spark, d)).filter("stopword_overlap < 0.10").select("doc_id")
    words = F.transform(T.split_words("text"), lambda w: F.regexp_replace(w, "^[.,!?;:()\"']+|[.,!?;:()\"']+$", ""))
    f = docs(spark, d).join(flagged, "doc_id", "left_semi").select(words.alias("w")).select((F.size(F.filter("w", lambda x: x.isin(T.ENGLISH_STOPWORDS))) / F.greatest(F.size("w"), F.lit(1))).alias("f"))
    return f.groupBy(F.when(F.col("f") < 0.1, "low").when(F.col("f") < 0.3, "middle").otherwise("high").alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


ARTIFACTS = {"replacement": 0xFFFD, "bom": 0xFEFF, "zero_width_space": 0x200B, "zero_width_joiner": 0x200D, "zero_width_non_joiner": 0x200C, "null": 0, "soft_hyphen": 0xAD, "no_break_space": 0xA0, "left_to_right": 0x200E, "right_to_left": 0x200F}


@query("artifact_census", " UNION ALL ".join(f"SELECT '{k}' AS artifact, count(*) FILTER (contains(text, chr({v}))) AS n_docs, coalesce(sum(length(text) - length(replace(text, chr({v}), ''))), 0)::BIGINT AS n_total FROM documents" for k, v in ARTIFACTS.items() if v) + " UNION ALL SELECT 'null', 0, 0")
def artifact_census(spark, d):
    counted = texts(spark, d).select(*[(F.length("text") - F.length(F.replace("text", F.lit(chr(v)), F.lit("")))).alias(k) for k, v in ARTIFACTS.items()])
    aggs = [x for k in ARTIFACTS for x in (F.count_if(F.col(k) > 0).alias(f"{k}_docs"), F.coalesce(F.sum(k), F.lit(0)).cast("long").alias(f"{k}_total"))]
    stacked = ", ".join(f"'{k}', {k}_docs, {k}_total" for k in ARTIFACTS)
    return counted.agg(*aggs).selectExpr(f"stack({len(ARTIFACTS)}, {stacked}) as (artifact, n_docs, n_total)")


@query("whitespace_census", f"SELECT count(*) FILTER (text <> regexp_replace(text, '^{_S}+|{_S}+$', '', 'g')) AS untrimmed, count(*) FILTER (regexp_matches(text, '\\n{{3,}}')) AS excess_newlines, count(*) FILTER (contains(text, chr(9))) AS tabs, sum(len(regexp_extract_all(text, '\\n{{3,}}')))::BIGINT AS newline_runs, sum(length(text) - length(replace(text, chr(9), '')))::BIGINT AS n_tabs FROM documents")
def whitespace_census(spark, d):
    t = F.col("text")
    return texts(spark, d).agg(
        F.count_if(t != T.strip(t)).alias("untrimmed"),
        F.count_if(t.rlike(r"\n{3,}")).alias("excess_newlines"),
        F.count_if(t.contains("\t")).alias("tabs"),
        F.sum(F.regexp_count(t, F.lit(r"\n{3,}"))).cast("long").alias("newline_runs"),
        F.sum(F.regexp_count(t, F.lit("\t"))).cast("long").alias("n_tabs"),
    )


@query("top_openings", f"SELECT opening, count(*) AS n, min(doc_id) AS first_id FROM (SELECT doc_id, regexp_replace(substr(text, 1, 50), '^{_S}+|{_S}+$', '', 'g') AS opening FROM documents WHERE text IS NOT NULL) GROUP BY opening ORDER BY n DESC, first_id LIMIT 10")
def top_openings(spark, d):
    o = docs(spark, d).filter("text is not null").select("doc_id", T.strip(F.substring("text", 1, 50)).alias("opening"))
    return o.groupBy("opening").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_id")).orderBy(F.desc("n"), "first_id").limit(10)


_CH = f"SELECT greatest(1, ceil(len({_WORDS}) / 128.0)) AS c FROM documents"


@query("chunk_buckets", f"SELECT CASE WHEN c <= 1 THEN '1' WHEN c <= 5 THEN '2-5' WHEN c <= 10 THEN '6-10' ELSE '>10' END AS bucket, count(*) AS n, max(c)::BIGINT AS most FROM ({_CH}) GROUP BY 1")
def chunk_buckets(spark, d):
    c = texts(spark, d).select(F.greatest(F.lit(1), F.ceil(F.size(T.split_words("text")) / 128.0)).alias("c"))
    return c.groupBy(F.when(F.col("c") <= 1, "1").when(F.col("c") <= 5, "2-5").when(F.col("c") <= 10, "6-10").otherwise(">10").alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.max("c").cast("long").alias("most"))


@query("context_fit", f"SELECT count(*) FILTER (n <= 1024) AS fits, avg(n) * 8013769 AS corpus_tokens, sum(greatest(1, ceil(n / 1024.0))) / count(*) * 8013769 AS corpus_samples FROM (SELECT len({_WORDS}) AS n FROM documents)")
def context_fit(spark, d):
    n = texts(spark, d).select(F.size(T.split_words("text")).alias("n"))
    return n.agg(F.count_if(F.col("n") <= 1024).alias("fits"), (F.avg("n") * 8_013_769).alias("corpus_tokens"), (F.sum(F.greatest(F.lit(1), F.ceil(F.col("n") / 1024.0))).cast("double") / F.count(F.lit(1)) * 8_013_769).alias("corpus_samples"))


@query("length_histogram", "SELECT b AS bin, count(*) AS n FROM (SELECT least(49, floor(least(n, p) / (p / 50)))::BIGINT AS b FROM (SELECT length(coalesce(text,''))::DOUBLE AS n FROM documents), (SELECT quantile_cont(length(coalesce(text,''))::DOUBLE, 0.99) AS p FROM documents)) GROUP BY b")
def length_histogram(spark, d):
    n = docs(spark, d).select(F.length(T.text_of("text")).cast("double").alias("n"))
    p = n.agg(F.percentile("n", F.lit(0.99)).alias("p"))
    width = F.col("p") / 50
    b = n.crossJoin(F.broadcast(p)).select(F.least(F.lit(49), F.floor(F.least("n", "p") / width)).cast("long").alias("bin"))  # one row
    return b.groupBy("bin").agg(F.count(F.lit(1)).alias("n"))


@query("token_stats", f"SELECT avg(n) AS mean, quantile_cont(n, 0.5) AS median, sum(n)::DOUBLE / sum(w) AS per_word FROM (SELECT len({_WORDS}) + 1 AS n, len({_WORDS}) AS w FROM documents)")
def token_stats(spark, d):
    """Mean and median of the tokens of a text, its end included, and tokens a word."""
    w = F.size(T.split_words("text"))
    return texts(spark, d).select((w + 1).alias("n"), w.alias("w")).agg(F.avg("n").alias("mean"), F.percentile("n", F.lit(0.5)).alias("median"), (F.sum("n").cast("double") / F.sum("w")).alias("per_word"))


@query("vocab_coverage", f"SELECT count(*) AS n_tokens, count(DISTINCT w) AS n_distinct FROM (SELECT unnest({_WORDS}) AS w FROM documents)")
def vocab_coverage(spark, d):
    by = texts(spark, d).select(F.explode(T.split_words("text")).alias("w")).groupBy("w").count()
    return by.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("n_tokens"), F.count(F.lit(1)).alias("n_distinct"))


# ----------------------------------------------------------------- pipeline


def cleaned(documents: DataFrame, normalise: bool = True) -> DataFrame:
    """(doc_id, source, text): texts after cleaning, that of wikis first. By way of generators of
    one row, as a filter on the result would else compute the patterns a second time."""
    checkpoint_dir(documents.sparkSession)
    wiki = F.coalesce(F.col("source") == "wikipedia", F.lit(False))
    raw = F.when(wiki, T.clean_wikipedia("text")).otherwise(T.text_of("text"))
    return documents.select("doc_id", "source", F.explode(F.array(raw)).alias("text")).select("doc_id", "source", F.explode(F.array(T.clean_text("text", normalise=normalise))).alias("text"))


def curate(documents: DataFrame, items: DataFrame, normalise: bool = True) -> DataFrame:
    """The survivors of the pipeline, in its order: clean, length, exact
    duplicates (least id), English where the source is not known to be so,
    13-word runs of evaluation text, length again.

    The cleaned texts that are long enough are written once to the shared
    folder, with the answer of the language rule, as later steps read them. The steps then work on digests, ids and
    flags; the texts meet the ids of the survivors once, at the end.
    """
    checkpoint_dir(documents.sparkSession)
    trusted = F.coalesce(F.col("source").isin("wikipedia", "bookcorpus"), F.lit(False))
    kept = cleaned(documents, normalise).filter(long_enough()).withColumn("english", trusted | T.is_english("text")).checkpoint()
    # the first of equal texts is chosen before its language is looked at
    first = kept.groupBy(F.md5("text").alias("h")).agg(F.min(F.struct("doc_id", "english")).alias("f")).filter("f.english").select("f.doc_id")
    leaked = decontam.ngram_hits(kept.filter("english"), items).select("doc_id")
    return kept.join(first.join(leaked, "doc_id", "left_anti"), "doc_id", "left_semi").drop("english")


_WIKI_RAW = f"CASE WHEN source = 'wikipedia' THEN {_WIKI_SQL} ELSE coalesce(text,'') END"
_CURATED = (
    f"WITH c AS (SELECT doc_id, source, lang, {clean_sql('z')} AS text FROM (SELECT doc_id, source, lang, {_WIKI_RAW} AS z FROM documents)), l AS (SELECT * FROM c WHERE length(text) >= CASE WHEN source = 'wikipedia' THEN 200 ELSE 50 END), "
    f"f AS (SELECT * FROM l WHERE doc_id IN (SELECT min(doc_id) FROM l GROUP BY text)), e AS (SELECT doc_id FROM ({_ENGLISH_SQL.replace('FROM documents', 'FROM l')}) WHERE english), "
    f"h AS ({_HITS.replace('FROM documents', 'FROM l')}) SELECT doc_id, md5(text) AS text_md5, length(text) AS n_chars FROM f WHERE (source IN ('wikipedia', 'bookcorpus') OR doc_id IN (SELECT doc_id FROM e)) AND doc_id NOT IN (SELECT doc_id FROM h)"
)


@query("curation_pipeline", _CURATED)
def curation_pipeline(spark, d):
    out = curate(texts(spark, d, "source"), table(spark, d, "eval_items"))
    return _brief(out, F.col("text"))


_FUNNEL = f"WITH a AS (SELECT doc_id, source, text FROM documents WHERE length(coalesce(text,'')) >= CASE WHEN source='wikipedia' THEN 200 ELSE 50 END), b AS (SELECT * FROM a WHERE doc_id IN (SELECT min(doc_id) FROM a GROUP BY text)), e AS (SELECT doc_id FROM ({_ENGLISH_SQL}) WHERE english), c AS (SELECT * FROM b WHERE source IN ('wikipedia','bookcorpus') OR doc_id IN (SELECT doc_id FROM e)), h AS ({_HITS}), f AS (SELECT * FROM c WHERE doc_id NOT IN (SELECT doc_id FROM h)), n AS (SELECT count(*) AS total FROM documents) "
_FUNNEL += " UNION ALL ".join(f"SELECT {i} AS step, '{name}' AS stage, (SELECT count(*) FROM {t}) AS n, 100.0 * (SELECT count(*) FROM {t}) / (SELECT total FROM n) AS pct" for i, (name, t) in enumerate((("raw", "documents"), ("length", "a"), ("exact_dedup", "b"), ("english", "c"), ("decontam", "f"))))


@query("funnel_counts", _FUNNEL)
def funnel_counts(spark, d):
    return funnel(texts(spark, d, "source"), table(spark, d, "eval_items"))


def funnel(documents: DataFrame, items: DataFrame) -> DataFrame:
    """(step, stage, n, pct): rows after each step of ``curate``, but its
    cleaning: one scan to the first of each long enough text, and one for the leaked ones."""
    english = F.coalesce(F.col("source").isin("wikipedia", "bookcorpus"), F.lit(False)) | T.is_english("text")
    rows = documents.select("doc_id", F.when(long_enough(), F.md5("text")).alias("h"), F.when(long_enough(), english).alias("english"))
    by = rows.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc_id", "english")).alias("f"))
    leaked = decontam.ngram_hits(documents, items).select("doc_id", F.lit(True).alias("leaked"))
    flat = by.select("n", F.col("h").isNotNull().alias("long"), "f.doc_id", "f.english").join(leaked, "doc_id", "left")
    kept = F.col("long") & F.col("english")
    one = flat.agg(F.sum("n").alias("raw"), F.coalesce(F.sum(F.when(F.col("long"), F.col("n"))), F.lit(0)).alias("length"), F.count_if("long").alias("exact_dedup"), F.count_if(kept).alias("english"), F.count_if(kept & F.col("leaked").isNull()).alias("decontam"))
    names = ("raw", "length", "exact_dedup", "english", "decontam")
    return one.selectExpr("raw AS total", f"stack(5, {', '.join(f'{i}, {n!r}, {n}' for i, n in enumerate(names))}) AS (step, stage, n)").select("step", "stage", "n", F.try_divide(F.lit(100.0) * F.col("n"), F.col("total")).alias("pct"))


_CLEANED = f"(SELECT doc_id, source, lang, {clean_sql('z')} AS text FROM (SELECT doc_id, source, lang, {_WIKI_RAW} AS z FROM documents))"


@query("funnel_counts_cleaned", _FUNNEL.replace("FROM documents", f"FROM {_CLEANED}").replace("(SELECT count(*) FROM documents)", f"(SELECT count(*) FROM {_CLEANED})"))
def funnel_counts_cleaned(spark, d):
    """The same over the cleaned texts, which are written once."""
    return funnel(cleaned(texts(spark, d, "source")).checkpoint(), table(spark, d, "eval_items"))
