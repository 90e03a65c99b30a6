"""One query per operator over its whole table, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.staging import stage
from . import (
    chat_format, decontaminate, kd_shards, language_crf, license_scan, line_dedup, ngram_join, packing, quality_rules, spelling, token_align,
    token_files, url_rules,
)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and conversation -1 that consists of control strings, formatted and read back."""
    chats = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    turns = chats.unionByName(probe).withColumn("parts", chat_format.text_part(F.col("text")))
    back = chat_format.read_back(chat_format.format_chats(turns))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id", "n_turns", F.sha2(said, 256).alias("turns_sha256"), F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))


def _sql_escape(column: str) -> str:
    out = f"replace(coalesce({column}, ''), chr(27), chr(27) || '0')"
    for c in chat_format.CONTROLS:
        out = f"replace({out}, '{c}', '{c[0]}' || chr(27) || '1{c[1:]}')"
    return out


ORACLES["op3_chat_format"] = f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
g AS (
  SELECT conv_id, count(*) AS n_turns,
    string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS said,
    coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '') AS loss,
    sum(length('<s>[ROLE][/ROLE]</s>') + length({_sql_escape('role')}) + length({_sql_escape('text')})
      + CASE WHEN role = 'user' THEN length('[INST][/INST]') ELSE 0 END) AS formatted_chars
  FROM t GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(said) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256,
  CAST(formatted_chars AS BIGINT) AS formatted_chars FROM g"""


@query
def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document and its place in a sequence of at most 2048 tokens."""
    return packing.pack(table(spark, sf_dir, "documents"), capacity=2048, tokenizer="word_bpe_49k.json", end_id=0)


@query
def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents written as coded token files in the shared folder, and read back from there."""
    files = stage(token_files.segments(table(spark, sf_dir, "documents"), "byte_bpe_50k.json", end_id=2))
    return token_files.documents(files)


@query
def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of all documents whose sets of three-word shingles are alike to nine tenths."""
    return ngram_join.jaccard_groups(table(spark, sf_dir, "documents"), n=3, num=90, den=100)


ORACLES["op7_ngram_join"] = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
s AS (
  SELECT doc_id, unnest(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 3 THEN [array_to_string(words, ' ')]
    ELSE list_distinct(list_transform(range(1, len(words) - 1), lambda i: array_to_string(words[i:i + 2], ' '))) END) AS shingle FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL),
link AS (
  SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 90 * (x.n + y.n - k)),
e AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
reach AS (SELECT a AS doc_id, a AS other FROM e UNION SELECT r.doc_id, e.b FROM reach r JOIN e ON e.a = r.other)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(min(r.other), d.doc_id)) AS component_id
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN reach r USING (doc_id) GROUP BY d.doc_id, n.n"""


@query
def op9_language_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from the labelled ones that are not held out."""
    docs = table(spark, sf_dir, "documents").withColumn("held_out", language_crf.is_held_out(F.col("doc_id")))
    model = language_crf.fit(docs.where("NOT held_out AND doc_id IS NOT NULL").select("text", "lang", F.col("doc_id").alias("key")))
    return language_crf.predict(docs, model, ["doc_id", "held_out"])


@query
def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item that a document holds, exactly or edited."""
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base figures, hard rules and the verdict of the weighed votes for every document."""
    figures = stage(quality_rules.figures(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text"))
    return quality_rules.judged(figures).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality", "votes")


@query
def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the runs of at least 50 words that occur earlier."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.dedup_lines(docs).select("doc_id", "line_dedup.n_lines", "line_dedup.n_removed_lines", "text")


@query
def op4_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 shards of nearly equal bytes."""
    placed = kd_shards.shard(table(spark, sf_dir, "documents"), 24)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query
def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The licence of every document, its own or its directory's. Documents have no path, so one is made of their columns:
    short documents (at most 400 code points) stand as notices in source/lang/<1024 ids>, all others are files one
    directory further down, in <32 ids>."""
    notice = F.length(F.coalesce("text", F.lit(""))) <= 400
    path = F.concat_ws("/", F.coalesce("source", F.lit("_")), F.coalesce("lang", F.lit("_")), F.shiftright("doc_id", 10).cast("string"),
                       F.when(~notice, F.shiftright("doc_id", 5).cast("string")), F.col("doc_id").cast("string"))
    files = table(spark, sf_dir, "documents").select("doc_id", "text", path.alias("path"), notice.alias("notice"))
    found = license_scan.licences(files, "doc_id", licence_file=F.col("notice"))
    return found.select("doc_id", "licence.name", "licence.origin", "licence.score", "licence.directory")


def _license_sql() -> str:
    w = license_scan.weights(license_scan.TEMPLATES)
    templates = ", ".join(f"('{name}', '{text}')" for name, text in license_scan.TEMPLATES.items())
    return rf"""
WITH t(name, txt) AS (VALUES {templates}),
tt AS (SELECT name, unnest(regexp_extract_all(lower(txt), '[a-z0-9]+')) AS term FROM t),
tc AS (SELECT name, term, count(*) AS k FROM tt GROUP BY ALL),
df AS (SELECT term, ln((1 + {len(license_scan.TEMPLATES)}) / (1.0 + count(*))) + 1 AS idf FROM tc GROUP BY term),
tn AS (SELECT name, sqrt(sum((k * idf) ** 2)) AS norm FROM tc JOIN df USING (term) GROUP BY name),
d AS (
  SELECT doc_id, coalesce(source, '_') || '/' || coalesce(lang, '_') || '/' || (doc_id >> 10) AS up2, length(coalesce(text, '')) <= 400 AS notice,
    coalesce(source, '_') || '/' || coalesce(lang, '_') || '/' || (doc_id >> 10) ||
      CASE WHEN length(coalesce(text, '')) <= 400 THEN '' ELSE '/' || (doc_id >> 5) END AS dir,
    regexp_split_to_array(regexp_replace(lower(coalesce(text, '')), '([.!?])[ 	]+', '' || chr(10), 'g'), '
') AS parts FROM documents),
s AS (SELECT doc_id, unnest(parts) AS s, generate_subscripts(parts, 1) - 1 AS i FROM d),
w AS (SELECT doc_id, i, unnest(regexp_extract_all(s, '[a-z0-9]+')) AS term FROM s),
wc AS (SELECT doc_id, i, term, count(*) AS k FROM w GROUP BY ALL),
wn AS (SELECT doc_id, i, sqrt(sum((k * coalesce(idf, {w['']!r})) ** 2)) AS own FROM wc LEFT JOIN df USING (term) GROUP BY ALL),
dot AS (SELECT doc_id, i, name, sum(wc.k * tc.k * idf ** 2) AS dot FROM wc JOIN tc USING (term) JOIN df USING (term) GROUP BY ALL),
sc AS (SELECT doc_id, i, name, round(dot / (norm * own), 6) AS score FROM dot JOIN tn USING (name) JOIN wn USING (doc_id, i)),
own AS (
  SELECT doc_id, name, score FROM sc WHERE score >= 0.75 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, i, name) = 1),
spoken AS (
  SELECT dir, name, score FROM d JOIN own USING (doc_id) WHERE notice
  QUALIFY row_number() OVER (PARTITION BY dir ORDER BY score DESC, name, dir || '/' || doc_id) = 1)
SELECT doc_id, coalesce(o.name, p.name) AS name, CASE WHEN o.name IS NOT NULL THEN 'own' WHEN p.name IS NOT NULL THEN 'inherited' END AS origin,
  coalesce(o.score, p.score) AS score, CASE WHEN o.name IS NOT NULL THEN d.dir ELSE p.dir END AS directory
FROM d LEFT JOIN own o USING (doc_id) LEFT JOIN spoken p ON p.dir = d.up2"""


ORACLES["op1_license_scan"] = _license_sql()


URL_RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"),
             ("net", "/fr/", "block")]


@query
def op11_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's url judged by the longest rule that fits it."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_rules.judge(pages, url_rules.rules_of(spark, URL_RULES)).select("page_id", "host", "path", "rule", "verdict")


ORACLES["op11_url_rules"] = rf"""
WITH r(h, p, v) AS (VALUES {", ".join(str(r) for r in URL_RULES)}),
a AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
b AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM a),
u AS (
  SELECT row_number() OVER () AS i, page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM b)
SELECT page_id, host, path, h || p AS rule, coalesce(v, 'allow') AS verdict
FROM u LEFT JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
QUALIFY row_number() OVER (PARTITION BY i ORDER BY length(h || p) DESC) = 1"""

#: What a word of `op12_spelling` is made of, and its least code points.
LETTERS, LEAST_LETTERS = r"a-zÀ-ÿ", 7


def corpus_words(docs: DataFrame) -> DataFrame:
    """(word): the runs of letters of all texts, one code point deleted where 31 divides the hash of document and run."""
    found = docs.select("doc_id", F.explode(spelling.runs(F.col("text"), LETTERS, LEAST_LETTERS)).alias("run"))
    h = F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), "run"))
    found = found.select("run", h.alias("h"), (h % F.length("run")).cast("int").alias("at"))
    cut = F.concat(F.substr("run", F.lit(1), F.col("at")), F.substr("run", F.col("at") + 2))
    return found.select(F.when(F.col("h") % 31 == 0, cut).otherwise(F.col("run")).alias("word")).where(F.length("word") >= LEAST_LETTERS)


@query
def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of all documents and the forms they are variants of."""
    words = stage(spelling.word_counts(corpus_words(table(spark, sf_dir, "documents")), 2))
    return spelling.variants(words, times=10)


ORACLES["op12_spelling"] = r"""
WITH RECURSIVE
k AS (SELECT list_reduce(range(0, 8), lambda c, s: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) AS v, i FROM range(0, 256) t(i)),
crc AS (SELECT list(v ORDER BY i) AS t FROM k),
r AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[a-z\x{C0}-\x{FF}]+')) AS run FROM documents),
d AS (SELECT doc_id, run, count(*) AS k, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)) AS raw FROM r WHERE length(run) >= 7 GROUP BY ALL),
h AS (
  SELECT run, k, xor(4294967295, list_reduce(list_transform(range(0, length(raw) // 2), lambda i: ('0x' || substr(raw, 2 * i + 1, 2))::BIGINT),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295)) AS h FROM d, crc),
w AS (
  SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word,
    sum(k)::BIGINT AS n FROM h GROUP BY 1),
words AS (SELECT word, n FROM w WHERE n >= 2 AND length(word) >= 7),
c AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words),
cut AS (SELECT word, n, i, substr(word, 1, i - 1) AS a, substr(word, i + 1) AS b FROM c),
pair AS (
  SELECT x.word, x.n, y.word AS other, y.n AS m FROM cut x JOIN cut y ON x.i = y.i AND x.a = y.a AND x.b = y.b AND x.word <> y.word
  UNION SELECT x.word, x.n, y.word, y.n FROM cut x JOIN words y ON x.a || x.b = y.word
  UNION SELECT y.word, y.n, x.word, x.n FROM cut x JOIN words y ON x.a || x.b = y.word),
near AS (SELECT word, n, count(*) AS n_near, first(other ORDER BY m DESC, other) AS best, max(m) AS m FROM pair GROUP BY word, n),
f AS (
  SELECT words.word, words.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 10 * words.n THEN best END AS form, CASE WHEN m >= 10 * words.n THEN m END AS form_n
  FROM words LEFT JOIN near USING (word)),
go AS (SELECT word, word AS root, form AS next FROM f UNION ALL SELECT go.word, f.word, f.form FROM go JOIN f ON f.word = go.next)
SELECT f.word, form, root, n, n_near, form_n FROM f JOIN go ON go.word = f.word AND go.next IS NULL"""


@query
def op13_token_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the tokens of two tokenizers go together in every document."""
    return token_align.align(table(spark, sf_dir, "documents"), "byte_bpe_50k.json", "piece_bpe_32k.model")
