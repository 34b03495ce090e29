"""The best k of each query, kept while a partition streams by."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


class Best:
    """Scores of batches of documents come in as matrices; what is held is k rows a
    query, ordered by falling score, then by rising id."""

    def __init__(self, queries: int, k: int, id_type: pa.DataType):
        self.queries, self.k, self.id_type = queries, k, id_type
        self.query, self.score = np.zeros(0, np.int64), np.zeros(0)
        self.ids = pa.array([], id_type)

    def add(self, ids: pa.Array, scores: np.ndarray, valid: np.ndarray | None = None) -> None:
        """scores: documents x queries; `valid` marks the pairs that count, all by default."""
        if not scores.size:
            return
        if self.k < len(scores):
            ranked = scores if valid is None else np.where(valid, scores, -np.inf)
            least = np.partition(ranked, len(scores) - self.k, axis=0)[len(scores) - self.k]
            wanted = ranked >= least
            wanted = wanted if valid is None else wanted & valid
        else:
            wanted = np.ones(scores.shape, bool) if valid is None else valid
        doc, query = np.nonzero(wanted)
        self._merge(query, scores[doc, query], ids.take(pa.array(doc)))

    def _merge(self, query: np.ndarray, score: np.ndarray, ids: pa.Array) -> None:
        query, score = np.concatenate([self.query, query]), np.concatenate([self.score, score])
        ids = pa.concat_arrays([self.ids, ids.cast(self.id_type)])
        order = np.lexsort((_order_of(ids), -score, query))
        query = query[order]
        # The place within the query's rows.
        begin = np.searchsorted(query, np.arange(self.queries))
        kept = np.arange(len(query)) - begin[query] < self.k
        order = order[kept]
        self.query, self.score, self.ids = query[kept], score[order], ids.take(pa.array(order))

    def batch(self, query_ids: pa.Array, id_col: str) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [query_ids.take(pa.array(self.query)), self.ids, pa.array(self.score)], ["query_id", id_col, "score"]
        )


def _order_of(ids: pa.Array) -> np.ndarray:
    """Numbers that rise with the ids."""
    values = ids.to_numpy(zero_copy_only=False)
    if values.dtype != object:
        return values
    return np.unique(values.astype(str), return_inverse=True)[1]


def rounded(scores: np.ndarray, digits: int = 4) -> np.ndarray:
    """Half away from zero, as SQL rounds."""
    scale = 10.0**digits
    return np.sign(scores) * np.floor(np.abs(scores) * scale + 0.5) / scale
