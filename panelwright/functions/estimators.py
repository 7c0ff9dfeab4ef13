"""NumPy and Arrow bodies of ``mapInPandas`` and ``mapInArrow`` steps: each adds up what one task sees."""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle

# Ship these functions inside the task, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


_CELLS, _ROWS = 2_000_000, 64  # cells and rows of one dense block, so scratch memory does not grow with the batch


def _dense(lengths, column, value, n_columns):
    """Sparse rows, given by the number, columns and values of their entries, some at a time: the first of these
    rows, the columns that occur in them and a dense matrix over these, which is what BLAS multiplies fastest."""
    upto = np.r_[0, np.cumsum(lengths)]
    step = min(_ROWS, max(1, _CELLS // max(n_columns, 1)))
    for start in range(0, len(lengths), step):
        part = slice(upto[start], upto[min(start + step, len(lengths))])
        size = lengths[start : start + step]
        seen = np.zeros(n_columns, dtype=bool)
        seen[column[part]] = True
        columns = np.flatnonzero(seen)
        place = np.cumsum(seen) - 1
        cell = np.repeat(np.arange(len(size)) * len(columns), size) + place[column[part]]
        filled = np.bincount(cell, weights=value[part], minlength=len(size) * len(columns))
        yield start, columns, filled.reshape(len(size), len(columns))


def _entries(idx, val):
    """Number, columns and values of the entries of Arrow lists ``idx, val``."""
    return pc.list_value_length(idx).to_numpy(), idx.flatten().to_numpy(), val.flatten().to_numpy()


def gram_product(shared):
    """``mapInArrow`` body for ``A'(A Q)`` of rows ``idx, val``: one row per term seen in the task."""

    def multiply(batches):
        basis = shared.value
        total = np.zeros_like(basis)
        seen = np.zeros(len(basis), dtype=bool)
        for batch in batches:
            for _, columns, block in _dense(*_entries(batch.column("idx"), batch.column("val")), len(basis)):
                total[columns] += block.T @ (block @ basis[columns])
                seen[columns] = True
        at, width = np.flatnonzero(seen), basis.shape[1]
        step = max(1, _CELLS // width)
        for start in range(0, len(at), step):
            part = at[start : start + step]
            offsets = np.arange(len(part) + 1, dtype="int32") * width
            z = pa.ListArray.from_arrays(pa.array(offsets), pa.array(total[part].ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(part.astype("int32")), z], names=["t", "z"])

    return multiply


def row_product(shared):
    """``mapInPandas`` body that projects sparse rows on a dense matrix."""

    def project(batches):
        for pdf in batches:
            if not len(pdf):
                continue
            lengths = pdf["idx"].map(len).to_numpy()
            column = np.concatenate(pdf["idx"].to_numpy()).astype(int)
            value = np.concatenate(pdf["val"].to_numpy()).astype(float)
            made = [block @ shared.value[columns] for _, columns, block in _dense(lengths, column, value, len(shared.value))]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "e": list(np.concatenate(made))})

    return project


_WORDS = 200_000  # words handled at once; a longer document is a part of its own


def _parts(batch):
    """First column and word lists of some rows at a time."""
    at = batch.schema.get_field_index("words")
    upto = np.cumsum(pc.fill_null(pc.list_value_length(batch.column(at)), 0).to_numpy(zero_copy_only=False))
    start = 0
    while start < len(upto):
        done = upto[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(upto, done + _WORDS, side="right")))
        yield batch.column(0).slice(start, end - start), batch.column(at).slice(start, end - start)
        start = end


def _terms(words):
    """Row and text of each term of some word lists: the words, then the pairs of neighbouring words."""
    lengths = pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False)
    row, word = np.repeat(np.arange(len(words)), lengths), words.flatten()
    inside = row[1:] == row[:-1]
    pairs = pc.binary_join_element_wise(word.slice(0, max(len(word) - 1, 0)), word.slice(1), " ").filter(pa.array(inside))
    return np.concatenate([row, row[1:][inside]]), pa.concat_arrays([word, pairs])


def _counted(row, code, n_codes):
    """Row, code and number of each code within its row, in that order."""
    key, times = np.unique(row * n_codes + code, return_counts=True)
    return key // n_codes, key % n_codes, times


def _coded(words):
    """Row, code, number of each term within its row, and the text of each code; codes are in order of the text."""
    row, term = _terms(words)
    coded = term.dictionary_encode()
    order = pc.sort_indices(coded.dictionary)
    rank = np.empty(len(order), dtype=np.int64)
    rank[order.to_numpy()] = np.arange(len(order))
    return *_counted(row, rank[coded.indices.to_numpy()], max(len(order), 1)), coded.dictionary.take(order)


def _lists(row, n_rows, values):
    """One list per row of values that are in order of the row."""
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(n_rows + 1)).astype("int32")), pa.array(values))


def term_totals(batches):
    """``mapInArrow`` body: ``term, df, total`` of some rows ``words`` at a time."""
    for batch in batches:
        for _, words in _parts(batch):
            _, code, times, text = _coded(words)
            df = np.bincount(code, minlength=len(text))
            total = np.bincount(code, weights=times, minlength=len(text)).astype("int64")
            yield pa.RecordBatch.from_arrays([text, pa.array(df), pa.array(total)], names=["term", "df", "total"])


def row_profile(batches):
    """``mapInArrow`` body: terms, distinct terms, characters, first and largest count of each row ``id, words`` with a term."""
    names = ["id", "n_terms", "n_distinct", "n_chars", "first_term", "top_count"]
    for batch in batches:
        for ids, words in _parts(batch):
            row, code, times, text = _coded(words)
            if not len(row):
                continue
            first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
            chars = pc.utf8_length(text).to_numpy().astype("int64")[code] * times
            sums = [np.add.reduceat(v, first) for v in (times, np.ones_like(times), chars)]
            made = [*map(pa.array, sums), text.take(pa.array(code[first])), pa.array(np.maximum.reduceat(times, first))]
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(row[first])), *made], names=names)


def known_terms(shared):
    """``mapInArrow`` body: ``id, idx, tf`` of each row ``id, words`` with a known term; the broadcast holds the terms by ``idx``."""

    def count(batches):
        vocabulary = pa.array(shared.value, pa.string())
        for batch in batches:
            for ids, words in _parts(batch):
                row, term = _terms(words)
                at = pc.index_in(term, value_set=vocabulary)
                known = at.is_valid().to_numpy(zero_copy_only=False)
                row, idx, tf = _counted(row[known], at.drop_null().to_numpy().astype("int64"), max(len(vocabulary), 1))
                made = [ids, _lists(row, len(ids), idx.astype("int32")), _lists(row, len(ids), tf)]
                held = pa.array(np.bincount(row, minlength=len(ids)) > 0)
                yield pa.RecordBatch.from_arrays(made, names=["id", "idx", "tf"]).filter(held)

    return count


def unit_weights(shared):
    """``mapInArrow`` body: ``id, idx, val`` of rows ``id, idx, tf``, length one; the broadcast holds the weight of each ``idx``."""

    def weigh(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, idx, tf = batch.columns
            row = np.repeat(np.arange(len(ids)), pc.list_value_length(idx).to_numpy())
            raw = tf.flatten().to_numpy() * shared.value[idx.flatten().to_numpy()]
            raw /= np.sqrt(np.bincount(row, weights=raw * raw, minlength=len(ids)))[row]
            yield pa.RecordBatch.from_arrays([ids, idx, _lists(row, len(ids), raw)], names=["id", "idx", "val"])

    return weigh
