"""The registered queries of the text operators: digests of what the operators return over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mlframe.llm import bpe, langid, linededup, mix, neardup, pq, quality, secrets, substring, tokens, topk, toxicity, whiten
from mlframe.llm.common import documents
from mlframe.llm.vectors import with_group_total
from mlframe.session import materialize, scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def tokenizer_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query
def op1_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes from each document."""
    docs = documents(spark, sf_dir, "doc_id", "text", "source")
    plan, sources, n = mix.planned(docs)
    rows = [(r.source, int(r.source_size), float(r.target)) for r in sources.itertuples()]
    known = spark.createDataFrame(rows, "s string, source_size long, target double")
    out = plan.join(F.broadcast(known), F.col("source").eqNullSafe(F.col("s")), "left")
    return out.select("doc_id", F.col(n.size).alias("size"), "source_size", "target",
                      (F.col(n.size) * F.size(n.draws)).alias("taken"), F.col(n.draws)["shard"].alias("shards"))


@query
def op2_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate class and exact-copy class of each document, by their smallest doc_id."""
    return neardup.near_duplicates(documents(spark, sf_dir, "doc_id", "text"))


@query
def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets found in each document, as counts and spans."""
    found = secrets.find_secrets(documents(spark, sf_dir, "doc_id", "text"))

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    base = F.filter("secrets", lambda s: s["kind"].isin(*secrets.BASE))
    def counted(kind):
        return F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *map(counted, secrets.BASE), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("secrets")).alias("spans"))


@query
def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of each document and how many went as repeated chunks, with a digest of the rest."""
    out = linededup.dedup_lines(documents(spark, sf_dir, "doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed", F.md5("text").alias("kept_md5"))


ORACLES["op4_line_dedup"] = """
WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents WHERE text IS NOT NULL),
r AS (SELECT doc_id, lines, [('0x' || substr(md5(CASE WHEN i = 1 THEN '' ELSE md5(lines[i - 1]) END || md5(lines[i])), 1, 7))::BIGINT % 3 = 0
      FOR i IN range(1, len(lines) + 1)] AS marks FROM d),
e AS (SELECT doc_id, lines, [i FOR i IN range(1, len(lines) + 1) IF marks[i] OR i = len(lines)] AS ends FROM r),
c AS (SELECT doc_id, unnest(range(1, len(ends) + 1)) AS no, lines, ends FROM e),
p AS (SELECT doc_id, no, lines[CASE WHEN no = 1 THEN 1 ELSE ends[no - 1] + 1 END:ends[no]] AS part FROM c),
q AS (SELECT doc_id, no, part, array_to_string(part, chr(10)) AS chunk,
      len([1 FOR x IN part IF regexp_matches(x, '[^\\x20\\x09-\\x0D]')]) >= 2 AS whole FROM p),
w AS (SELECT *, whole AND row_number() OVER (PARTITION BY whole, chunk ORDER BY doc_id, no) > 1 AS gone FROM q),
k AS (SELECT doc_id, sum(CASE WHEN gone THEN len(part) ELSE 0 END) AS n_removed,
      md5(coalesce(string_agg(chunk, chr(10) ORDER BY no) FILTER (NOT gone), '')) AS kept_md5 FROM w GROUP BY doc_id)
SELECT doc_id, coalesce(len(string_split(text, chr(10))), 0)::BIGINT AS n_lines, coalesce(n_removed, 0)::BIGINT AS n_removed, kept_md5
FROM documents LEFT JOIN k USING (doc_id)"""


def training_rows():
    """The rows that op5 may learn from: crc32 of doc_id as text, modulo 4, is not 2."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2


@query
def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of each document, with whether its row was held out from learning."""
    docs = documents(spark, sf_dir, "doc_id", "text", "lang")
    samples = langid.labelled_sample(docs, training_rows())
    found = langid.identify(docs.select("doc_id", "text"), samples)
    return found.select("doc_id", (~training_rows()).alias("held_out"), "lang_pred", "score")


@query
def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality measures and verdict of each document."""
    return quality.judge(documents(spark, sf_dir, "doc_id", "text")).drop("text", "clean_text")


@query
def op7_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten best inner products of each vector whose id is divisible by 100."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return topk.top_k(vectors, vectors.filter("vec_id % 100 = 0"), 10)


@query
def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of each document, written as files and read back."""
    out = scratch_path(spark, "token-ids")
    tokens.write_ids(documents(spark, sf_dir, "doc_id", "text"), out, tokenizer_file())
    return tokens.read_ids(spark, out).select(F.col("key").alias("doc_id"), "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@query
def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of each document's ids and of the text decoded from them."""
    back = bpe.encode(documents(spark, sf_dir, "doc_id", "text"), tokenizer_file(), decoded=True)
    return back.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@query
def op10_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of each document that lie in spans which stand elsewhere too, with a digest of the rest."""
    out = substring.cut_spans(documents(spark, sf_dir, "doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def embeddings(spark: SparkSession, sf_dir: str, *cols: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(*cols)


@query
def op11_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Product-quantisation code of each vector, its error and the error of its label."""
    vectors = embeddings(spark, sf_dir, "vec_id", "embedding", "label")
    books = pq.fit(vectors)
    coded = materialize(pq.compress(vectors, books).select("vec_id", "code", "error", "label"), "codes")
    out = with_group_total(coded, "label", "error", "label_error", lambda df: materialize(df, "label-errors"))
    return out.select("vec_id", "code", "error", "label_error", F.lit(books.digest() if books else None).alias("codebooks_sha256"))


def _codes_sql(rounds: int = 4) -> str:
    """Plain assignment to all entries, round by round."""
    near = ("SELECT vec_id, part, min_by(entry, (d, entry)) AS entry, min(d) AS d FROM (SELECT p.vec_id, p.part, b.entry, "
            "list_sum(list_transform(list_zip(p.x, b.y), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM p JOIN {b} b USING (part)) GROUP BY ALL")
    ctes = ["k AS MATERIALIZED (SELECT vec_id, label, [floor(1024 * c::DOUBLE)::BIGINT FOR c IN embedding] AS v FROM embeddings "
            "WHERE embedding IS NOT NULL AND len([1 FOR c IN embedding IF c IS NULL OR NOT isfinite(c)]) = 0)",
            "p AS MATERIALIZED (SELECT vec_id, part, v[part * (len(v) // 4) + 1:(part + 1) * (len(v) // 4)] AS x FROM k, range(4) r(part))",
            "f AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM k QUALIFY entry < 256)",
            "b0 AS MATERIALIZED (SELECT part, entry, x AS y FROM p JOIN f USING (vec_id))"]
    for i in range(rounds):
        ctes += [f"a{i} AS MATERIALIZED ({near.format(b=f'b{i}')})",
                 f"c{i} AS (SELECT part, entry, i, floor(sum(x[i])::DOUBLE / count(*))::BIGINT AS m FROM a{i} JOIN p USING (vec_id, part), "
                 "(SELECT unnest(range(1, (SELECT max(len(x)) FROM p) + 1)) AS i) GROUP BY ALL)",
                 f"m{i} AS (SELECT part, entry, list(m ORDER BY i) AS y FROM c{i} GROUP BY ALL)",
                 f"b{i + 1} AS MATERIALIZED (SELECT part, entry, coalesce(m{i}.y, b{i}.y) AS y FROM b{i} LEFT JOIN m{i} USING (part, entry))"]
    ctes += [f"a{rounds} AS MATERIALIZED ({near.format(b=f'b{rounds}')})",
             f"e AS (SELECT vec_id, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM a{rounds} GROUP BY vec_id)",
             "l AS (SELECT label, sum(error)::BIGINT AS label_error FROM e JOIN k USING (vec_id) GROUP BY label)",
             f"h AS (SELECT sha256(string_agg(array_to_string(y, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM b{rounds})"]
    return (f"WITH {', '.join(ctes)} SELECT vec_id, code, error, label_error, codebooks_sha256 "
            "FROM e JOIN k USING (vec_id) JOIN l ON l.label IS NOT DISTINCT FROM k.label, h")


ORACLES["op11_codes"] = _codes_sql()


@query
def op12_whiten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coordinates of each vector on the 32 leading components, scaled to variance one."""
    vectors = embeddings(spark, sf_dir, "vec_id", "embedding")
    fitted = whiten.fit(vectors)
    rows = whiten.whitened(vectors, fitted).select("vec_id", "deviation", F.posexplode("whitened").alias("place", "whitened"))
    shares = [float(v) / fitted.trace for v in fitted.values] if fitted else []
    return rows.select("vec_id", (F.col("place") + 1).alias("component"), F.lit(fitted.n if fitted else 0).cast("long").alias("n"), "deviation", "whitened",
                       F.get(F.array(*map(F.lit, shares)).cast("array<double>"), F.col("place")).alias("explained"),
                       F.lit(fitted.identity_error if fitted else None).cast("double").alias("identity_error"))


@query
def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of each document, with whether its label was held out from learning."""
    docs = documents(spark, sf_dir, "doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    scored = toxicity.score(docs, toxicity.fit(docs, labels, training_rows()))
    return scored.select("doc_id", (~training_rows()).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
