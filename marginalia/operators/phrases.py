"""Phrases: words side by side in one field.

A query token with a separator inside (``foo_bar``) is a phrase of its words. Phrases are cut into pieces of at most three words, which are
looked up among the runs of words of each paper where its text lies; only what is found is shuffled. A phrase begins where
``position - offset`` is the same for all its pieces.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from marginalia.functions import text as X
from marginalia.session import BROADCAST_BYTES, materialize

FIELDS = ("title", "authors", "abstract")
# Words of a piece, and pieces sent to the executors at once; more of them take another scan of the papers.
PIECE = 3
PIECES = 200_000


def query_phrases(queries: DataFrame) -> DataFrame:
    """query_id, phrase, words: the distinct phrases of each query, of one word or more; ``phrase`` is the words with blanks between."""
    phrases = queries.select("query_id", F.explode(X.keyword_phrases(F.col("text"))).alias("words"))
    return phrases.select("query_id", F.array_join("words", " ").alias("phrase"), "words").distinct()


def word_positions(docs: DataFrame, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """paper_id, field, position, term of every word of the fields of ``docs(id, ...)``. A null field has no word."""
    tokens: Column = F.array(*[X.words(F.col(f)) for f in fields])
    placed = docs.select(F.col("id").alias("paper_id"), F.posexplode(tokens).alias("field", "tokens"))
    return placed.select("paper_id", "field", F.posexplode("tokens").alias("position", "term"))


def phrase_counts(docs: DataFrame, phrases: DataFrame, fields: tuple[str, ...] = FIELDS, most: int = PIECES) -> DataFrame:
    """phrase, paper_id, tf: how often each of the distinct ``phrases(phrase, words)`` occurs in a paper; overlapping ones count each.

    Papers that lack a phrase have no row, nor has a null id. Rows that share an id are one paper whose words lie over each other.
    """
    repeated = materialize(docs.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1 and id is not null").select("id"), "repeated")
    if repeated.isEmpty():
        return _piece_counts(docs, phrases, fields, most)
    shared = docs.join(repeated, "id", "left_semi")
    apart = _piece_counts(docs, phrases, fields, most).join(repeated.withColumnRenamed("id", "paper_id"), "paper_id", "left_anti")
    return apart.select("phrase", "paper_id", "tf").unionByName(_position_counts(docs, shared, phrases, fields))


def phrase_pieces(phrases: DataFrame) -> DataFrame:
    """phrase, pieces (their number), offset, width, piece: runs of PIECE words that cover the phrase, the last of which may overlap the one
    before; a shorter phrase is one piece."""
    n = F.size("words")
    last = F.greatest(n - PIECE, F.lit(0))
    starts = F.array_distinct(F.concat(F.sequence(F.lit(0), last, F.lit(PIECE)), F.array(last)))
    cut = phrases.filter(n > 0).select("phrase", "words", F.size(starts).alias("pieces"), F.explode(starts).alias("offset"))
    piece = F.slice("words", F.col("offset") + 1, F.lit(PIECE))
    return cut.select("phrase", "pieces", "offset", F.size(piece).alias("width"), F.array_join(piece, " ").alias("piece"))


def word_runs(docs: DataFrame, widths: list[int], fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """paper_id, field, position, piece of every run of so many words of the fields of ``docs(id, ...)``."""
    tokens: Column = F.array(*[X.words(F.col(f)) for f in fields])
    placed = docs.select(F.col("id").alias("paper_id"), F.posexplode(tokens).alias("field", "tokens"))

    def runs(width: int) -> Column:
        if width == 1:
            return F.transform("tokens", lambda w, i: F.struct(i.alias("position"), w.alias("piece")))
        ends = F.slice("tokens", width, F.greatest(F.size("tokens"), F.lit(1)))
        return F.transform(ends, lambda w, i: F.struct(i.alias("position"), F.array_join(F.slice("tokens", i + 1, F.lit(width)), " ").alias("piece")))
    # One list per width: the runs of all widths are never held together.
    rows = [placed.select("paper_id", "field", F.explode(runs(w)).alias("run")).select("paper_id", "field", "run.position", "run.piece") for w in widths]
    out = rows[0]
    for other in rows[1:]:
        out = out.unionByName(other)
    return out


def _piece_counts(docs: DataFrame, phrases: DataFrame, fields: tuple[str, ...], most: int) -> DataFrame:
    """phrase, paper_id, tf of papers with an id of their own. Pieces go to the executors in parts of at most ``most`` rows."""
    pieces = materialize(phrase_pieces(phrases), "pieces")
    docs = docs.filter("id is not null")
    # One row per width, at most PIECE of them.
    found = pieces.groupBy("width").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("piece") + F.octet_length("phrase")).alias("bytes"), F.max("pieces").alias("pieces")).collect()
    if not found:
        return _position_counts(docs.limit(0), docs.limit(0), phrases, fields)
    parts = max(math.ceil(sum(r["n"] for r in found) / most), math.ceil(sum(r["bytes"] for r in found) / BROADCAST_BYTES))
    # A whole phrase goes to one part, so a part finds all its pieces.
    met = []
    for part in range(parts):
        own = pieces.filter(F.pmod(F.xxhash64("phrase"), F.lit(parts)) == part) if parts > 1 else pieces
        met.append(word_runs(docs, sorted(r["width"] for r in found), fields).join(F.broadcast(own.drop("width")), "piece"))
    single = [m.filter("pieces = 1").groupBy("phrase", "paper_id").agg(F.count(F.lit(1)).alias("tf")) for m in met]
    if max(r["pieces"] for r in found) > 1:
        several = [m.filter("pieces > 1").groupBy("phrase", "pieces", "paper_id", "field", (F.col("position") - F.col("offset")).alias("begin"))
                   .agg(F.count(F.lit(1)).alias("together")).filter("together = pieces").groupBy("phrase", "paper_id").agg(F.count(F.lit(1)).alias("tf")) for m in met]
    else:
        several = []
    out, *others = single + several
    for other in others:
        out = out.unionByName(other)
    return out


def _position_counts(docs: DataFrame, shared: DataFrame, phrases: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """phrase, paper_id, tf of the papers ``shared`` by the positions of single words over all rows of a paper. Only the words of some phrase
    are placed, and only papers that hold a phrase's rarest word among ``docs`` are joined, by (paper, word)."""
    parts = phrases.select("phrase", F.size("words").alias("n"), F.posexplode("words").alias("offset", "term"))
    terms = materialize(parts.select("term").distinct(), "terms")
    df = word_positions(docs, fields).join(terms, "term", "left_semi").select("term", "paper_id").distinct().groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    placed = materialize(word_positions(shared, fields).join(terms, "term", "left_semi"), "positions")
    papers = placed.groupBy("term", "paper_id").agg(F.count(F.lit(1)).alias("held"))
    # A phrase with a word no paper holds has no row; the least word of a tie is taken.
    known = parts.join(df, "term")
    rarest = (known.groupBy("phrase", "n").agg(F.count(F.lit(1)).alias("found"), F.min_by("term", F.struct("df", "term")).alias("term"))
              .filter(F.col("found") == F.col("n")).select("phrase", "term"))
    candidates = papers.select("term", "paper_id").join(rarest, "term").select("phrase", "paper_id")
    wanted = candidates.join(parts, "phrase")
    begun = wanted.join(placed, ["paper_id", "term"]).groupBy("phrase", "n", "paper_id", "field", (F.col("position") - F.col("offset")).alias("begin")).agg(
        F.count(F.lit(1)).alias("together"))
    return begun.filter(F.col("together") == F.col("n")).groupBy("phrase", "paper_id").agg(F.count(F.lit(1)).alias("tf"))


def phrase_scores(docs: DataFrame, phrases: DataFrame, k1: float, b: float, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """query_id, paper_id, score of the papers that hold every phrase of a query; ``phrases`` as from :func:`query_phrases`.

    A phrase weighs like a word: by the number of papers that hold it and its number of places in the paper. A phrase in more than half
    of the papers keeps a tiny positive weight.
    """
    lengths = docs.select(F.col("id").alias("paper_id"), F.aggregate(F.array(*[F.size(X.words(F.col(f))) for f in fields]), F.lit(0), lambda a, x: a + x).alias("doc_len"))
    n_docs, avg_len = lengths.agg(F.count(F.lit(1)), F.avg("doc_len")).first()
    tf = materialize(phrase_counts(docs, phrases.select("phrase", "words").distinct(), fields), "phrases")
    df = tf.groupBy("phrase").agg(F.count(F.lit(1)).alias("df"))
    odds = F.log((F.lit(float(n_docs)) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weights = df.select("phrase", "df", F.when(odds > 1e-6, odds).otherwise(1e-6).alias("idf"))
    needed = phrases.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_phrases"))
    known = phrases.select("query_id", "phrase").join(weights, "phrase")
    rarest = (known.groupBy("query_id").agg(F.count(F.lit(1)).alias("found"), F.min_by("phrase", F.struct("df", "phrase")).alias("phrase"))
              .join(needed, "query_id").filter(F.col("found") == F.col("n_phrases")).select("query_id", "phrase", "n_phrases"))
    pairs = rarest.join(tf.select("phrase", "paper_id"), "phrase").select("query_id", "n_phrases", "paper_id")
    joined = pairs.join(known.select("query_id", "phrase", "idf"), "query_id").join(tf, ["phrase", "paper_id"]).join(lengths, "paper_id")
    norm = F.lit(1.0 - b) + F.lit(b) * F.col("doc_len") / F.lit(float(avg_len or 1.0))
    return (joined.groupBy("query_id", "paper_id", "n_phrases")
            .agg(F.count(F.lit(1)).alias("held"), F.sum(F.col("idf") * (F.col("tf") * (k1 + 1.0)) / (F.col("tf") + k1 * norm)).alias("score"))
            .filter(F.col("held") == F.col("n_phrases")).select("query_id", "paper_id", "score"))
