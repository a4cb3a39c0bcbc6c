"""Tokens, vocabularies, id sequences (X)."""

from __future__ import annotations

from pyspark.sql import functions as F

from mlframe.functions.arrays import one_hot_tokens
from mlframe.operators import text
from mlframe.plans.catalog import query

_SEPS = text.SEPARATORS.replace("\t", "").replace("\n", "")


def words_sql(col: str = "text") -> str:
    chars = f"'{_SEPS}' || chr(9) || chr(10)"
    return (f"list_filter(string_split(translate(lower({col}), {chars}, repeat(' ', {len(text.SEPARATORS)})), ' '), "
            "lambda w: w <> '')")


def vocab_sql(table: str, key: str) -> str:
    """CTEs toks(key..., pos, word) and vocab(word, cnt, idx)."""
    return f"""
toks AS (SELECT {key}, pos - 1 AS pos, ws[pos] AS word FROM (
           SELECT {key}, ws, unnest(range(1, len(ws) + 1)) AS pos FROM (SELECT {key}, {words_sql()} AS ws FROM {table}))),
vocab AS (SELECT word, cnt, row_number() OVER (ORDER BY cnt DESC, f) AS idx FROM (
           SELECT word, count(*) AS cnt, min(({key}, pos)) AS f FROM toks GROUP BY word))"""


_DOCS = vocab_sql("documents", "doc_id")
_CONV = vocab_sql("conversations", "conv_id, turn")


def _docs(t):
    return t.spread("documents", "doc_id", "text")


def _doc_vocab(t):
    return text.build_vocab(_docs(t), "text", "doc_id")


def _conv(t):
    df = t("conversations")
    vocab = text.build_vocab(df, "text", ["conv_id", "turn"])
    return text.texts_to_sequences(df, "text", ["conv_id", "turn"], vocab), vocab


def ids_text(arr: str = "seq"):
    return F.array_join(F.transform(arr, lambda i: i.cast("string")), " ")


@query(f"WITH {_DOCS} SELECT word, count(*) AS cnt FROM toks GROUP BY word")
def word_counts(t):
    """X1."""
    return text.word_counts(_docs(t), "text")


@query(f"WITH {_DOCS} SELECT word, count(DISTINCT doc_id) AS docs FROM toks GROUP BY word")
def word_document_counts(t):
    """Texts per word."""
    return text.document_counts(_docs(t), "text")


@query(f"WITH {_DOCS} SELECT word, cnt, idx FROM vocab")
def vocabulary(t):
    """X2."""
    return _doc_vocab(t)


@query(f"""
WITH {_DOCS}, s AS (SELECT doc_id, string_agg(CAST(idx AS VARCHAR), ' ' ORDER BY pos) AS ids, count(*) AS n
                    FROM toks JOIN vocab USING (word) GROUP BY doc_id)
SELECT d.doc_id, coalesce(s.ids, '') AS ids, coalesce(s.n, 0) AS n FROM documents d LEFT JOIN s USING (doc_id)
""")
def text_sequences(t):
    """Every text as ids in order."""
    df = _docs(t)
    seqs = text.texts_to_sequences(df, "text", "doc_id", _doc_vocab(t))
    return seqs.select("doc_id", ids_text().alias("ids"), F.size("seq").alias("n"))


@query(f"""
WITH {_CONV}, users AS (SELECT word FROM toks JOIN conversations USING (conv_id, turn) WHERE role = 'user'),
v AS (SELECT word, row_number() OVER (ORDER BY count(*) DESC, min(f)) AS idx FROM (
        SELECT word, (conv_id, turn, pos) AS f FROM toks JOIN conversations USING (conv_id, turn) WHERE role = 'user') GROUP BY word),
s AS (SELECT conv_id, turn, string_agg(CAST(idx AS VARCHAR), ' ' ORDER BY pos) AS ids FROM toks JOIN v USING (word) GROUP BY conv_id, turn)
SELECT c.conv_id, c.turn, coalesce(s.ids, '') AS ids FROM conversations c LEFT JOIN s USING (conv_id, turn) WHERE c.role <> 'user'
""")
def unknown_words_dropped(t):
    """The vocabulary of one part applied to the other; the head limit forces the shuffle path too."""
    df, key = t("conversations"), ["conv_id", "turn"]
    vocab = text.build_vocab(df.filter("role = 'user'"), "text", key)
    seqs = text.texts_to_sequences(df.filter("role <> 'user'"), "text", key, vocab, head=100)
    return seqs.select(*key, ids_text().alias("ids"))


def _padded_sql(pick: str, place: str) -> str:
    return f"""
WITH {_CONV}, s AS (SELECT conv_id, turn, pos, idx, count(*) OVER (PARTITION BY conv_id, turn) AS n FROM toks JOIN vocab USING (word)),
kept AS (SELECT conv_id, turn, idx, {place} AS place FROM s WHERE {pick}),
grid AS (SELECT conv_id, turn, unnest(range(12)) AS place FROM conversations)
SELECT g.conv_id, g.turn, string_agg(CAST(coalesce(k.idx, 0) AS VARCHAR), ' ' ORDER BY g.place) AS ids
FROM grid g LEFT JOIN kept k USING (conv_id, turn, place) GROUP BY g.conv_id, g.turn
"""


@query(_padded_sql("pos >= n - 12", "12 - n + pos"))
def padded_front(t):
    """Zeros and cuts at the front."""
    seqs, _ = _conv(t)
    return text.pad_sequences(seqs, "seq", 12).select("conv_id", "turn", ids_text().alias("ids"))


@query(_padded_sql("pos < 12", "pos"))
def padded_back(t):
    """Zeros and cuts at the back."""
    seqs, _ = _conv(t)
    return text.pad_sequences(seqs, "seq", 12, "post", "post").select("conv_id", "turn", ids_text().alias("ids"))


@query(f"""
WITH {_CONV}, s AS (SELECT conv_id, turn, string_agg(CAST(CASE WHEN idx < 500 THEN idx ELSE 2 END AS VARCHAR), ' ' ORDER BY pos) AS ids, count(*) AS n
FROM toks JOIN vocab USING (word) GROUP BY conv_id, turn)
SELECT conv_id, turn, coalesce(ids, '') AS ids FROM conversations LEFT JOIN s USING (conv_id, turn) WHERE coalesce(n, 0) < 60
""")
def capped_sequences(t):
    """Rare words become one id, over-long texts are dropped."""
    seqs, _ = _conv(t)
    out = text.cap_ids(text.drop_long(seqs, "seq", 60), "seq", 500, unknown=2)
    return out.select("conv_id", "turn", ids_text().alias("ids"))


@query(f"WITH {_DOCS} SELECT word, cnt, idx FROM vocab WHERE idx < 1000")
def capped_vocabulary(t):
    """X5."""
    return text.cap_vocab(_doc_vocab(t), 1000)


@query(f"WITH {_DOCS} SELECT max(idx) + 1 AS vocab_size FROM vocab")
def vocabulary_size(t):
    """X6."""
    return text.vocab_size(_doc_vocab(t))


@query(f"WITH {_CONV} SELECT conv_id, turn, pos, idx FROM toks JOIN vocab USING (word)")
def token_stream(t):
    """One row per token id."""
    seqs, _ = _conv(t)
    return text.token_stream(seqs, "seq", ["conv_id", "turn"])


@query(f"""
WITH {_CONV}, v AS (SELECT * FROM vocab WHERE idx < 20),
s AS (SELECT conv_id, turn, idx, row_number() OVER (PARTITION BY conv_id, turn ORDER BY pos) - 1 AS place,
             count(*) OVER (PARTITION BY conv_id, turn) AS n FROM toks JOIN v USING (word)),
kept AS (SELECT conv_id, turn, idx, 5 - n + place AS place FROM s WHERE place >= n - 5),
grid AS (SELECT conv_id, turn, place, unnest(range(20)) AS class FROM (SELECT conv_id, turn, unnest(range(5)) AS place FROM conversations))
SELECT g.conv_id, g.turn, g.place, g.class, CAST(coalesce(k.idx, 0) = g.class AS INTEGER) AS cell
FROM grid g LEFT JOIN kept k USING (conv_id, turn, place)
""")
def one_hot_tokens_long(t):
    """Each place of a padded sequence as a one-hot vector, in long form."""
    df, key = t("conversations"), ["conv_id", "turn"]
    vocab = text.cap_vocab(text.build_vocab(df, "text", key), 20)
    padded = text.pad_sequences(text.texts_to_sequences(df, "text", key, vocab), "seq", 5)
    hot = padded.select(*key, F.posexplode(one_hot_tokens("seq", 20)).alias("place", "vec"))
    return hot.select(*key, "place", F.posexplode("vec").alias("class", "cell"))
