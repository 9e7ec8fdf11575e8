"""Language identification: multinomial naive Bayes over hashed character n-grams.

The n-grams of every labelled text are counted in tasks with numpy, summed by Spark per language
and slot, and turned into one matrix of log-probabilities (2**bits slots x languages), which is
broadcast. Its size depends on the parameters and the number of languages only. Scoring looks up
the row of every n-gram of a batch of texts and adds the rows of each text.

Defined results. A null text or one without letters: ``und``, score 0. No labelled row at all:
``und``, score 0 for every row. Ties go to the language first in code-point order. Repeated rows
are scored (and counted) once per row. Other columns pass through; they are read by name only.
Texts above ``PIECE`` characters are cut at the next white space, and no n-gram crosses the cut.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapelab.llm.batches import sliced

PIECE = 1 << 20  # a longer text is cut
SLICE = 1 << 18  # characters looked at together
CHANCE = 3.0  # deviations of the mean of as many letters that count as chance
_SEP = 1  # no letter folds to it
_fold = None


def _table() -> np.ndarray:
    """Lower-cased letter for every code point, 0 for anything else."""
    global _fold
    if _fold is None:
        table = np.zeros(0x110000, np.uint32)
        for c in range(0x110000):
            s = chr(c)
            if s.isalpha():
                low = s.lower()
                table[c] = ord(low) if len(low) == 1 else c
        _fold = table
    return _fold


def _pieces(text: str) -> Iterator[str]:
    at = 0
    while len(text) - at > PIECE:
        m = re.compile(r"\s").search(text, at + PIECE, at + 2 * PIECE)
        end = m.start() if m else at + PIECE
        yield text[at:end]
        at = end
    yield text[at:]


def _slices(texts: list) -> Iterator[tuple[list[int], list[str]]]:
    """(row numbers, pieces) of about SLICE characters together."""
    rows, out, size = [], [], 0
    for i, t in enumerate(texts):
        for p in _pieces(t or ""):
            rows.append(i)
            out.append(p)
            size += len(p)
            if size >= SLICE:
                yield rows, out
                rows, out, size = [], [], 0
    if out:
        yield rows, out


def _grams(pieces: list[str], bits: int, orders: tuple[int, ...]):
    """Slots of all n-grams as one array per order, start of each piece, letters per piece.

    A slot of 2**bits marks an n-gram that would cross from one piece into the next.
    """
    lens = np.array([len(p) + 3 for p in pieces], np.int64)
    starts = np.concatenate(([0], np.cumsum(lens)[:-1]))
    joined = "".join(f"  {p} " for p in pieces)
    f = _table()[np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4")]
    f[starts] = _SEP
    keep = f > 0
    keep[1:] |= f[:-1] > 0  # runs of other characters become one blank
    place = np.cumsum(keep) - 1
    starts = place[starts]
    f = f[keep]
    letters = np.add.reduceat((f > _SEP).astype(np.int64), starts)
    out, h, sep = [], np.zeros(len(f), np.uint32), np.zeros(len(f), bool)
    for n in range(1, max(orders) + 1):
        nxt = f[n - 1:]
        h = h[: len(nxt)] * np.uint32(0x01000193) + nxt
        sep = sep[: len(nxt)] | (nxt == _SEP)
        if n in orders:
            slot = ((h + np.uint32(n * 0x3C6EF372)) * np.uint32(2654435761) >> np.uint32(32 - bits)).astype(np.int32)
            slot[sep] = 1 << bits
            out.append(np.concatenate((slot, np.full(len(f) - len(slot), 1 << bits, np.int32))))
    return out, starts, letters


def _counter(text: str, lang: str, bits: int, orders: tuple[int, ...]):
    def run(batches):
        total: dict[str, np.ndarray] = {}
        docs: dict[str, int] = {}
        for b in sliced(batches):
            texts, langs = b.column(text).to_pylist(), b.column(lang).to_pylist()
            for name in langs:
                docs[name] = docs.get(name, 0) + 1
            for rows, pieces in _slices(texts):
                slots, starts, _ = _grams(pieces, bits, orders)
                ends = np.append(starts[1:], len(slots[0]))
                for name in {langs[i] for i in rows}:
                    acc = total.setdefault(name, np.zeros((1 << bits) + 1, np.int64))
                    pick = np.concatenate([np.arange(s, e) for i, s, e in zip(rows, starts, ends) if langs[i] == name])
                    for s in slots:
                        acc += np.bincount(s[pick], minlength=(1 << bits) + 1)
        for name in docs:
            acc = total[name][:-1]
            at = np.flatnonzero(acc)
            yield pa.RecordBatch.from_pydict({
                "lang": [name] * (len(at) + 1), "slot": np.append(at, -1), "n": np.append(acc[at], docs[name])})

    return run


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", bits: int = 16, orders: tuple[int, ...] = (1, 2, 3),
        alpha: float = 0.1) -> dict | None:
    """Train on all rows with a non-null language; None if there is none.

    What comes to the driver is at most 2**bits counts per language.
    """
    rows = docs.select(F.col(text).alias("text"), F.col(lang).alias("lang")).where(F.col("lang").isNotNull())
    counts = (rows.mapInArrow(_counter("text", "lang", bits, orders), "lang string, slot long, n long")
              .groupBy("lang", "slot").agg(F.sum("n").alias("n")).toArrow())
    if counts.num_rows == 0:
        return None
    names, slot, n = counts.column("lang").to_pylist(), counts.column("slot").to_numpy(), counts.column("n").to_numpy()
    langs = sorted(set(names))
    place = {x: i for i, x in enumerate(langs)}
    col = np.array([place[x] for x in names])
    table = np.zeros((1 << bits, len(langs)))
    prior = np.zeros(len(langs))
    grams = slot >= 0
    table[slot[grams], col[grams]] = n[grams]
    prior[col[~grams]] = n[~grams]
    used = int((table.sum(axis=1) > 0).sum()) + 1
    logp = np.log((table + alpha) / (table.sum(axis=0) + alpha * used))
    # what an n-gram of the language's own texts gets from the others: mean and deviation, of a nat at least
    whole = np.maximum(table.sum(axis=0), 1)
    own = np.log((np.maximum(table - 1, 0) + alpha) / (whole - 1 + alpha * used))
    mean = (table * own).sum(axis=0) / whole
    spread = np.maximum(np.sqrt((table * (own - mean) ** 2).sum(axis=0) / whole), 1.0)
    logp = np.vstack([logp, np.zeros(len(langs))]).astype(np.float32)  # the last row is for n-grams left out
    return {"langs": langs, "logp": logp, "prior": np.log(prior / prior.sum()), "bits": bits, "orders": orders, "mean": mean, "spread": spread}


def _scorer(model, text: str, names: list[str], misfit: bool):
    def run(batches):
        m = model.value
        langs, logp, prior, bits, orders = m["langs"], m["logp"], m["prior"], m["bits"], m["orders"]
        for b in sliced(batches):
            texts = b.column(text).to_pylist()
            sums, letters = np.tile(prior, (len(texts), 1)), np.zeros(len(texts), np.int64)
            seen = np.zeros(len(texts), np.int64)
            for rows, pieces in _slices(texts):
                slots, starts, k = _grams(pieces, bits, orders)
                at = np.array(rows)
                for s in slots:
                    np.add.at(sums, at, np.add.reduceat(logp[s], starts, axis=0, dtype=np.float64))
                    if misfit:
                        np.add.at(seen, at, np.add.reduceat((s < 1 << bits).astype(np.int64), starts))
                np.add.at(letters, at, k)
            best = sums.argmax(axis=1)
            odds = np.exp(sums - sums.max(axis=1, keepdims=True))
            score = 1.0 / odds.sum(axis=1)
            known = letters > 0
            pred = [langs[i] if k else "und" for i, k in zip(best, known)]
            out = {"lang_pred": pa.array(pred, pa.string()), "score": pa.array(np.where(known, score, 0.0))}
            if misfit:
                n = np.maximum(seen, 1)
                mean = (sums[np.arange(len(texts)), best] - prior[best]) / n
                short = (m["mean"][best] - mean) / m["spread"][best] - CHANCE * np.sqrt(len(orders) / n)
                out["misfit"] = pa.array(np.where(known, short, 0.0))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), *out.values()], names=[*names, *out])

    return run


def predict(docs: DataFrame, model: dict | None, text: str = "text", keep_text: bool = False, misfit: bool = False) -> DataFrame:
    """``docs``, its text only if ``keep_text``, with ``lang_pred`` and ``score``. A column of those names is replaced.

    ``misfit`` adds a column of that name: by how many deviations of an n-gram of the predicted
    language the text's mean log-likelihood per n-gram is below that language's own, less what
    chance explains in a text of that length. Unlike ``score`` it does not run to 1 with length.
    """
    added = ["lang_pred", "score", *(["misfit"] if misfit else [])]
    docs = docs.drop(*(c for c in added if c != text))
    names = [c for c in docs.columns if keep_text or c != text]
    if model is None:
        return docs.select(*names).withColumns({c: F.lit("und" if c == "lang_pred" else 0.0) for c in added})
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([docs.schema[c] for c in names]
                          + [T.StructField(c, T.StringType() if c == "lang_pred" else T.DoubleType()) for c in added])
    return docs.mapInArrow(_scorer(shared, text, names, misfit), schema)


def held_out(doc_id="doc_id"):
    """Rows that are never learnt from: crc32 of the id as text, modulo 4, is 2 (a null id counts as '')."""
    return (F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 4) == 2


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row, trained on the rows that are not held out."""
    docs = docs.select("doc_id", "text", "lang")
    model = fit(docs.where(~held_out()).select("text", "lang"))
    return predict(docs.select("doc_id", held_out().alias("held_out"), "text"), model)
