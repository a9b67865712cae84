"""Arrow kernels of the lexical scorers: each batch of chunks yields its own best rows per query.

A chunk is one row, so nothing about the corpus is shuffled; only ``k`` rows per query and batch
leave the task. The query side is a sparse term-by-query matrix in a Spark broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Term-query products held at once by one task.
PRODUCTS = 4_000_000
DENSE = 16_000_000
# Scores a task remembers, ``k`` a query; with more queries than that it remembers none.
REMEMBERED = 4_000_000
# Rows are bounded by a dense product over at most so many terms: those whose products are at least a thousandth of the cells.
HEAVY = 512
CELLS_PER_PRODUCT = 1000
# Words matched at once.
WORDS = 200_000


class QueryMatrix(NamedTuple):
    """Row t lists the queries that hold term t with their weight."""
    terms: list
    starts: np.ndarray
    query: np.ndarray
    weight: np.ndarray
    query_ids: list


def query_matrix(rows: list) -> QueryMatrix:
    """From ``(query_id, term, weight)`` rows."""
    query_ids = sorted({r[0] for r in rows})
    terms = sorted({r[1] for r in rows})
    place_q, place_t = {q: i for i, q in enumerate(query_ids)}, {t: i for i, t in enumerate(terms)}
    t = np.array([place_t[r[1]] for r in rows], dtype=np.int64)
    order = np.argsort(t, kind="stable")
    starts = np.concatenate([[0], np.cumsum(np.bincount(t, minlength=len(terms)))]).astype(np.int64)
    return QueryMatrix(terms, starts, np.array([place_q[r[0]] for r in rows], dtype=np.int64)[order],
                       np.array([r[2] for r in rows], dtype=np.float64)[order], query_ids)


def term_counts(tokens: pa.ListArray, vocabulary: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, term, count) of the vocabulary terms of each row's tokens."""
    flat = pc.index_in(tokens.flatten(), value_set=vocabulary)
    row = pc.list_parent_indices(tokens)
    known = pc.is_valid(flat)
    row, term = (np.asarray(x.filter(known)).astype(np.int64) for x in (row, flat))
    width = max(len(vocabulary), 1)
    keys, counts = np.unique(row * width + term, return_counts=True)
    return keys // width, keys % width, counts


def term_products(row, term, value, matrix: QueryMatrix):
    """(``row * n_queries + query``, value x weight) of every query that holds the row's term."""
    fan = matrix.starts[term + 1] - matrix.starts[term]
    source = np.repeat(np.arange(len(term)), fan)
    entry = np.arange(len(source)) - np.repeat(np.cumsum(fan) - fan, fan) + matrix.starts[term][source]
    return row[source] * len(matrix.query_ids) + matrix.query[entry], value[source] * matrix.weight[entry]


def pair_scores(row, term, value, matrix: QueryMatrix):
    """Sums of value x weight per (row, query): sorted keys ``row * n_queries + query``, scores, terms found."""
    keys, products = term_products(row, term, value, matrix)
    if len(keys) == 0:
        return keys, products, keys
    low, span = keys.min(), keys.max() - keys.min() + 1
    if span <= DENSE:
        sums, hit = np.bincount(keys - low, weights=products, minlength=span), np.bincount(keys - low, minlength=span)
        found = np.flatnonzero(hit)
        return found + low, sums[found], hit[found]
    unique, inverse = np.unique(keys, return_inverse=True)
    return unique, np.bincount(inverse, weights=products), np.bincount(inverse)


def best_rows(keys, scores, order, width: int, k: int, digits: int = 9):
    """(row, query, score) of the ``k`` best rows of each query, ties by ``order[row]``."""
    row, query, score = keys // width, keys % width, np.round(scores, digits)
    ranked = np.lexsort((order[row], -score, query))
    ranked = ranked[score[ranked] > 0]
    sorted_query = query[ranked]
    first = np.searchsorted(sorted_query, sorted_query, side="left")
    kept = ranked[np.arange(len(ranked)) - first < k]
    return row[kept], query[kept], score[kept]


class Best:
    """The ``k`` best rounded scores of each query that a task has met. A row that scores less than all of them is not among the
    query's best, so it need not be sorted or sent."""

    def __init__(self, width: int, k: int):
        self.scores = np.zeros((width, k)) if 0 < width * k <= REMEMBERED else None

    def least(self) -> np.ndarray:
        return self.scores[:, -1]

    def add(self, query: np.ndarray, score: np.ndarray) -> None:
        """Rows as :func:`best_rows` returns them: by query, best first, at most ``k`` each."""
        if self.scores is None or not len(query):
            return
        which, first, place = np.unique(query, return_index=True, return_inverse=True)
        fresh = np.zeros((len(which), self.scores.shape[1]))
        fresh[place, np.arange(len(query)) - first[place]] = score
        both = np.concatenate([self.scores[which], fresh], axis=1)
        self.scores[which] = -np.sort(-both, axis=1)[:, :self.scores.shape[1]]


def score_bounds(row, term, value, n_rows: int, matrix: QueryMatrix) -> np.ndarray:
    """Scores of all (row, query) cells in single precision: terms of many products as a dense product, the others one by one."""
    width = len(matrix.query_ids)
    fan = matrix.starts[1:] - matrix.starts[:-1]
    load = np.bincount(term, minlength=len(fan)) * fan
    heavy = np.argsort(-load, kind="stable")[:HEAVY]
    heavy = heavy[load[heavy] * CELLS_PER_PRODUCT >= n_rows * width]
    place = np.full(len(fan), -1)
    place[heavy] = np.arange(len(heavy))
    dense = place[term] >= 0
    left = np.bincount(row[dense] * len(heavy) + place[term[dense]], weights=value[dense], minlength=n_rows * len(heavy))
    right = np.zeros((len(heavy), width), dtype=np.float32)
    for i, t in enumerate(heavy.tolist()):
        held = slice(matrix.starts[t], matrix.starts[t + 1])
        right[i, matrix.query[held]] = matrix.weight[held]
    keys, products = term_products(row[~dense], term[~dense], value[~dense], matrix)
    light = np.bincount(keys, weights=products, minlength=n_rows * width).reshape(n_rows, width)
    return left.reshape(n_rows, len(heavy)).astype(np.float32) @ right + light.astype(np.float32)


def promising(bounds: np.ndarray, least: np.ndarray) -> np.ndarray:
    """Rows that may reach the least score a query remembers, with room for the bounds' precision."""
    return (bounds >= np.maximum(least * (1 - 1e-4) - 1e-6, 1e-10).astype(np.float32)).any(axis=1)


def best_of_batch(row, term, value, paper, index, matrix: QueryMatrix, k: int, best: Best, order: np.ndarray | None = None,
                  boost: float | None = None, group: np.ndarray | None = None, home: np.ndarray | None = None,
                  needed: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
    """Rows of a batch that can be among the ``k`` best of a query, from its sorted postings; ``order`` breaks ties, by default the chunk id.

    Bounds choose the rows; only those are scored one product after the other, so equal rows get equal scores.
    """
    width = len(matrix.query_ids)
    fan = matrix.starts[term + 1] - matrix.starts[term]
    if boost is not None:
        follows = np.zeros(len(paper) + 1, dtype=bool)  # the row before is the chunk before
        follows[1:-1] = (paper[1:] == paper[:-1]) & (group[1:] == group[:-1]) & (index[1:] == index[:-1] + 1)
    for start, stop in slices(row, fan, len(paper)):
        # One neighbour on either side, so that boosted scores are complete inside the range.
        lo, hi = (max(start - 1, 0), min(stop + 1, len(paper))) if boost is not None else (start, stop)
        part = slice(np.searchsorted(row, lo), np.searchsorted(row, hi))
        rows, terms, values = row[part], term[part], value[part]
        chosen = np.ones(hi - lo, dtype=bool)
        if needed is None and best.scores is not None and best.scores.any() and (hi - lo) * width <= DENSE:
            bounds = score_bounds(rows - lo, terms, values, hi - lo, matrix)
            if boost is not None:
                beside = np.zeros_like(bounds)
                beside[1:] += bounds[:-1] * follows[lo + 1:hi, None]
                beside[:-1] += bounds[1:] * follows[lo + 1:hi, None]
                bounds += np.float32(boost) * beside
            chosen = promising(bounds, best.least())
            scored = chosen.copy()
            if boost is not None:
                scored[1:] |= chosen[:-1]
                scored[:-1] |= chosen[1:]
            held = scored[rows - lo]
            rows, terms, values = rows[held], terms[held], values[held]
        keys, scores, found = pair_scores(rows, terms, values, matrix)
        if needed is not None:
            whole = found == needed[keys % width]
            keys, scores = keys[whole], scores[whole]
        if len(keys) == 0:
            continue
        if boost is not None:
            scores = neighbour_boost(keys, scores, paper, group, index, width, boost)
            own = (keys >= start * width) & (keys < stop * width) & home[keys // width]
            keys, scores = keys[own], scores[own]
        keep = chosen[keys // width - lo]
        if best.scores is not None:
            keep &= scores >= best.least()[keys % width] - 1e-9
        keys, scores = keys[keep], scores[keep]
        if order is None:
            ties, some = np.zeros(len(paper), dtype=np.int64), np.unique(keys // width)
            ties[some] = id_order(paper[some], index[some])
        else:
            ties = order
        hits = best_rows(keys, scores, ties, width, k)
        best.add(hits[1], hits[2])
        if len(hits[0]):
            yield emit(matrix, *hits, paper, index)


def id_order(paper: np.ndarray, index: np.ndarray) -> np.ndarray:
    """Rank of each row's chunk id as a string."""
    ids = np.array([f"p{p}_c{i}" for p, i in zip(paper.tolist(), index.tolist())], dtype=object)
    rank = np.empty(len(ids), dtype=np.int64)
    rank[np.argsort(ids, kind="stable")] = np.arange(len(ids))
    return rank


def neighbour_boost(keys, scores, paper, group, index, width: int, weight: float):
    """Scores plus ``weight`` times those of the rows just before and after in the same group."""
    out = scores.copy()
    row = keys // width
    for shift in (-1, 1):
        other = np.clip(row + shift, 0, len(paper) - 1)
        beside = ((paper[other] == paper[row]) & (group[other] == group[row]) & (index[other] == index[row] + shift))
        wanted = keys + shift * width
        place = np.clip(np.searchsorted(keys, wanted), 0, len(keys) - 1)
        out += np.where(beside & (keys[place] == wanted), weight * scores[place], 0.0)
    return out


def slices(row: np.ndarray, fan: np.ndarray, n_rows: int) -> Iterator[tuple[int, int]]:
    """Row ranges whose term-query products stay within ``PRODUCTS`` (at least one row each)."""
    load = np.cumsum(np.bincount(row, weights=fan, minlength=n_rows))
    start = 0
    while start < n_rows:
        base = load[start - 1] if start else 0.0
        stop = max(start + 1, int(np.searchsorted(load, base + PRODUCTS, side="right")))
        yield start, min(stop, n_rows)
        start = stop


def emit(matrix: QueryMatrix, row, query, score, paper, index) -> pa.RecordBatch:
    ids = [matrix.query_ids[q] for q in query.tolist()]
    return pa.RecordBatch.from_arrays(
        [pa.array(ids), pa.array(paper[row]), pa.array(index[row], pa.int32()), pa.array(score, pa.float64())],
        names=["query_id", "paper_id", "chunk_index", "score"])


def score_batch(batch: pa.Table, matrix: QueryMatrix, vocabulary: pa.Array, saturate, k: int,
                boost: float | None = None, needed: np.ndarray | None = None, best: Best | None = None) -> Iterator[pa.RecordBatch]:
    """Best rows of one table ``(paper_id, chunk_index, doc_len, tokens[, block, home])``.

    ``saturate(count, doc_len)`` turns a term count into its score factor. With ``needed`` a row must hold
    that many terms of the query, and ties go by paper number. ``best`` is what the task remembers of earlier tables.
    """
    tokens = batch["tokens"].combine_chunks()
    tokens = tokens.chunk(0) if isinstance(tokens, pa.ChunkedArray) else tokens
    paper, index, length = (np.asarray(batch[c]) for c in ("paper_id", "chunk_index", "doc_len"))
    row, term, count = term_counts(tokens, vocabulary)
    value = saturate(count.astype(np.float64), length[row])
    group, home = (np.asarray(batch[c]) for c in ("block", "home")) if boost is not None else (None, None)
    yield from best_of_batch(row, term, value, paper, index, matrix, k, best or Best(len(matrix.query_ids), k),
                             None if needed is None else paper, boost, group, home, needed)


def whole_groups(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[pa.Table]:
    """Regroup sorted batches so that equal values of ``columns`` never straddle two tables."""
    held: pa.Table | None = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        if table.num_rows == 0:
            continue
        held = table if held is None else pa.concat_tables([held, table])
        last = [held[c][-1].as_py() for c in columns]
        same = None
        for c, v in zip(columns, last):
            eq = np.asarray(pc.equal(held[c], v))
            same = eq if same is None else same & eq
        start = int(np.argmax(same))
        if start:
            yield held.slice(0, start).combine_chunks()
            held = held.slice(start)
    if held is not None:
        yield held.combine_chunks()


def only_known(batch: pa.RecordBatch, column: str, vocabulary: pa.Array) -> pa.RecordBatch:
    """The batch with the lists of ``column`` reduced to the values in ``vocabulary``, repetitions and order kept."""
    lists = batch.column(column)
    values = lists.flatten()
    keep = pc.is_in(values, value_set=vocabulary)
    owner = np.asarray(pc.list_parent_indices(lists))[np.asarray(keep)]
    offsets = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(lists)))]).astype(np.int32)
    kept = pa.ListArray.from_arrays(pa.array(offsets), values.filter(keep))
    return pa.RecordBatch.from_arrays([kept if n == column else batch.column(n) for n in batch.schema.names], batch.schema.names)


def overlaps_itself(token: str) -> bool:
    """Whether a beginning of the token is also an end of it."""
    border = [0] * len(token)
    for i in range(1, len(token)):
        k = border[i - 1]
        while k and token[i] != token[k]:
            k = border[k - 1]
        border[i] = k + (token[i] == token[k])
    return bool(token) and border[-1] > 0


def count_tokens_in_words(tokens: pa.ListArray, automaton, texts: list[str], looped: np.ndarray):
    """(row, token, occurrences): non-overlapping occurrences of each query token inside the row's words, by row; a row that
    holds a token in several words names it several times.

    Distinct words of the batch are matched once, in one text: tokens hold no white space, so none crosses the breaks. The
    automaton's values are positions in ``texts``. Its matches may overlap only for tokens that are ``looped``
    (:func:`overlaps_itself`); those are counted in their words.
    """
    coded = tokens.flatten().dictionary_encode()
    words, n_tokens = coded.dictionary, len(texts)
    pairs, n = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for begin in range(0, len(words), WORDS):
        part = words.slice(begin, WORDS)
        held = part.to_pylist()
        ends = np.cumsum(np.asarray(pc.utf8_length(part)).astype(np.int64) + 1)
        hits = np.fromiter(automaton.iter("\n".join(held)), dtype="i8,i8")
        word = np.searchsorted(ends, hits["f0"], side="right") + begin
        found, times = np.unique(word * n_tokens + hits["f1"], return_counts=True)
        for i in np.flatnonzero((times > 1) & looped[found % n_tokens]).tolist():
            times[i] = held[found[i] // n_tokens - begin].count(texts[found[i] % n_tokens])
        pairs.append(found)
        n.append(times)
    pairs, n = np.concatenate(pairs), np.concatenate(n).astype(np.float64)
    fan = np.bincount(pairs // n_tokens, minlength=len(words)).astype(np.int64)
    starts = np.concatenate([[0], np.cumsum(fan)])
    row, word = np.asarray(pc.list_parent_indices(tokens)).astype(np.int64), np.asarray(coded.indices).astype(np.int64)
    keys, times = np.unique(row * max(len(words), 1) + word, return_counts=True)
    row, word = keys // max(len(words), 1), keys % max(len(words), 1)
    source = np.repeat(np.arange(len(word)), fan[word])
    entry = np.arange(len(source)) - np.repeat(np.cumsum(fan[word]) - fan[word], fan[word]) + starts[word][source]
    return row[source], pairs[entry] % n_tokens, times[source] * n[entry]
