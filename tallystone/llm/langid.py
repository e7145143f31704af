"""Language ID by a bidirectional gated recurrent network over bytes, in numpy.

The network reads windows of bytes in both directions, labels every position, and a
document's probabilities are the mean over its letters' positions. It is trained by
backpropagation through time on a bounded sample.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import binary_parts, byte_chunks, held_out, no_clash, with_text

#: Width of each direction, bytes of a window, windows scored at once.
HIDDEN, WINDOW, LANES = 8, 64, 2048
#: About so many rows of each language the model learns from, with their whole texts, and so many of all languages together.
PER_LANG, MOST_ROWS = 250, 4000
STEPS, BATCH = 220, 96
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True


def _forward(x: np.ndarray, p: dict[str, np.ndarray], keep: bool = False):
    """States of one direction for windows x (time, lanes): (time, hidden, lanes); with ``keep`` also what training needs.

    The reset and update gates are linear between 0 and 1, which costs a fraction of a sigmoid.
    """
    t, n = x.shape
    h = p["u"].shape[1]
    out = np.empty((t, h, n), np.float32)
    state, gates, rec = np.zeros((h, n), np.float32), np.empty((3 * h, n), np.float32), np.empty((3 * h, n), np.float32)
    r, z, c = gates[:h], gates[h : 2 * h], gates[2 * h :]
    kept = []
    for i in range(t):
        np.take(p["w"], x[i], axis=1, out=gates, mode="clip")
        np.matmul(p["u"], state, out=rec)
        gates[: 2 * h] += rec[: 2 * h]
        np.clip(gates[: 2 * h], 0, 1, out=gates[: 2 * h])
        inner = rec[2 * h :]
        inner += p["b"]
        if keep:
            c += r * inner
        else:
            inner *= r
            c += inner
        np.tanh(c, out=c)
        new = out[i]
        np.subtract(state, c, out=new)
        new *= z
        new += c
        if keep:
            kept.append((r.copy(), z.copy(), c.copy(), inner.copy(), state))
        state = new
    return (out, kept) if keep else out


def _backward(x, kept, d_out, p):
    """Gradients of one direction by backpropagation through time."""
    t, h, n = d_out.shape
    g = {k: np.zeros_like(v) for k, v in p.items()}
    by_byte = np.zeros((256, 3 * h), np.float32)
    d_state = np.zeros((h, n), np.float32)
    for i in range(t - 1, -1, -1):
        r, z, c, inner, before = kept[i]
        d = d_out[i] + d_state
        d_c = d * (1 - z) * (1 - c * c)
        d_z = d * (before - c) * ((z > 0) & (z < 1))
        d_r = d_c * inner * ((r > 0) & (r < 1))
        d_inner = d_c * r
        np.add.at(by_byte, x[i], np.concatenate((d_r, d_z, d_c)).T)
        d_rec = np.concatenate((d_r, d_z, d_inner))
        g["u"] += d_rec @ before.T
        g["b"] += d_inner.sum(axis=1, keepdims=True)
        d_state = d * z + p["u"].T @ d_rec
    g["w"] = by_byte.T.copy()
    return g


def train_network(texts: list[bytes], labels: np.ndarray, n_labels: int, steps: int = STEPS, seed: int = 3) -> dict:
    """Both directions' parameters and the output layer, fitted to windows of the texts by Adam."""
    rng = np.random.default_rng(seed)
    h = HIDDEN

    def direction():
        w = rng.normal(0, 0.3, (3 * h, 256))
        w[: 2 * h] = 0.5 + w[: 2 * h] / 3
        return {"w": w.astype(np.float32), "u": rng.normal(0, 0.2, (3 * h, h)).astype(np.float32), "b": np.zeros((h, 1), np.float32)}

    model = {"f": direction(), "r": direction(), "o": {"v": rng.normal(0, 0.3, (n_labels, 2 * h)).astype(np.float32), "c": np.zeros((n_labels, 1), np.float32)}}
    moments = {(a, k): (np.zeros_like(v), np.zeros_like(v)) for a, part in model.items() for k, v in part.items()}
    t = WINDOW // 2
    some = [i for i, x in enumerate(texts) if x]
    if not some or n_labels < 2:
        return model
    texts = [x.ljust(-(-len(x) // t) * t) for x in texts]  # as in scoring, a window is filled up with spaces
    by = [[i for i in some if labels[i] == y] for y in range(n_labels)]
    by = [b for b in by if b]
    for step in range(1, steps + 1):
        rows = [b[rng.integers(len(b))] for b in by for _ in range(-(-BATCH // len(by)))][: max(BATCH, len(by))]
        x = np.empty((t, len(rows)), np.uint8)
        for j, i in enumerate(rows):
            at = t * rng.integers(len(texts[i]) // t)
            x[:, j] = np.frombuffer(texts[i], np.uint8, t, at)
        y = labels[rows]
        (fwd, kf), (bwd, kb) = _forward(x, model["f"], True), _forward(x[::-1], model["r"], True)
        both = np.concatenate((fwd, bwd[::-1]), axis=1)
        logits = model["o"]["v"] @ both + model["o"]["c"]
        prob = np.exp(logits - logits.max(axis=1, keepdims=True))
        prob /= prob.sum(axis=1, keepdims=True)
        prob[:, y, np.arange(len(rows))] -= 1
        d = prob / np.float32(t * len(rows))
        d_both = model["o"]["v"].T @ d
        grads = {"o": {"v": np.einsum("tkn,thn->kh", d, both), "c": d.sum(axis=(0, 2))[:, None]}, "f": _backward(x, kf, d_both[:, :h], model["f"]), "r": _backward(x[::-1], kb, d_both[::-1, h:], model["r"])}
        rate = 0.03 * min(1.0, 2 * (1 - step / (steps + 1)))
        for (a, k), (m, v) in moments.items():
            g = grads[a][k]
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            model[a][k] -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
    return model


def probabilities(column: pa.Array, model: dict) -> Iterator[np.ndarray | None]:
    """For each text the mean probabilities over its letters' positions; None without a letter."""
    raw, offsets = binary_parts(column)
    n_labels, v = len(model["o"]["c"]), model["o"]["v"]
    for i, j in byte_chunks(offsets):
        size = np.diff(offsets[i : j + 1])
        text = np.concatenate((raw[offsets[i] : offsets[j]], np.zeros(WINDOW, np.uint8)))
        count = -(-size // WINDOW)
        owner = np.repeat(np.arange(j - i), count)
        within = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
        start = (offsets[i:j] - offsets[i])[owner] + within * WINDOW
        length = np.minimum(size[owner] - within * WINDOW, WINDOW)
        total, letters = np.zeros((j - i, n_labels)), np.zeros(j - i)
        for a in range(0, len(owner), LANES):
            lanes = slice(a, a + LANES)
            x = text[start[lanes][None, :] + np.arange(WINDOW)[:, None]]
            inside = np.arange(WINDOW)[:, None] < length[lanes][None, :]
            x = np.where(inside, x, 32).astype(np.uint8)
            fwd, bwd = _forward(x, model["f"]), _forward(x[::-1], model["r"])[::-1]
            h = fwd.shape[1]
            logits = v[:, :h] @ fwd
            logits += v[:, h:] @ bwd
            logits += model["o"]["c"]
            logits -= logits.max(axis=1, keepdims=True)
            np.exp(logits, out=logits)
            weight = (inside & _LETTER[x]).astype(np.float32)
            logits *= (weight / logits.sum(axis=1))[:, None]
            sums = logits.sum(axis=0).T
            np.add.at(total, owner[lanes], sums)
            np.add.at(letters, owner[lanes], weight.sum(axis=0))
        plain = np.concatenate(([0], np.cumsum(_LETTER[text[: offsets[j] - offsets[i]]] & (text[: offsets[j] - offsets[i]] < 128))))
        ascii_letters = np.diff(plain[offsets[i : j + 1] - offsets[i]])
        for d in range(j - i):
            if letters[d] and (ascii_letters[d] or any(map(str.isalpha, column[i + d].as_py()))):
                yield total[d] / letters[d]
            else:
                yield None


def train(docs: DataFrame, per_lang: int = PER_LANG) -> tuple[list[str], dict]:
    """Languages and model, from about ``per_lang`` different rows of each language, never the held-out ones.

    Rows are drawn by a hash of id and text, so repeated rows count once and any order of tasks gives
    one model. The driver holds the whole texts of about ``MOST_ROWS`` rows at most; where there are more
    languages than that, the most frequent ones are learned, the first by name of equals.
    """
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "lang", "text").where(~held_out())
    known = known.withColumn("mark", F.xxhash64("doc_id", "text"))
    counts = sorted((r.lang, r.rows) for r in known.groupBy("lang").agg(F.approx_count_distinct("mark").alias("rows")).orderBy(F.desc("rows"), "lang").limit(MOST_ROWS + 1).collect())
    if len(counts) > MOST_ROWS:
        counts = sorted(sorted(counts, key=lambda c: (-c[1], c[0]))[:MOST_ROWS])
    langs, per_lang = [x for x, _ in counts], min(per_lang, MOST_ROWS / max(1, len(counts)))
    if not langs:
        return [], train_network([], np.zeros(0, np.int64), 1)
    # as Arrow: rows of Python objects would go through Python workers of their own, which stay beside those that score
    shares = docs.sparkSession.createDataFrame(pa.table({"lang": pa.array(langs, pa.string()), "share": pa.array([min(1.0, 1.2 * per_lang / n) for _, n in counts], pa.float64())}))

    chosen = known.join(F.broadcast(shares), "lang").where(F.pmod("mark", F.lit(1 << 24)) < F.col("share") * (1 << 24)).select("lang", "mark", "text")  # a row a language
    rows = chosen.groupBy("lang", "mark").agg(F.min("text").alias("text")).collect()
    number = {x: i for i, x in enumerate(langs)}
    rows = sorted((r.lang, r.mark, r.text.encode("utf-8", "replace")) for r in rows)
    return langs, train_network([t for _, _, t in rows], np.asarray([number[x] for x, _, _ in rows], np.int64), len(langs))


def language(docs: DataFrame, per_lang: int = PER_LANG, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, lang_pred and score of every row, from its whole text alone.

    ``und`` with score 0 where the text is null or has no letter, or where no language
    could be learned; else the language of the highest mean probability, which is the
    score. Null or repeated ids are treated like others; texts of any length are read whole;
    ``keep`` may not name a column lang_pred or score.
    """
    no_clash(keep, "lang_pred", "score")
    langs, model = train(docs, per_lang)
    rows, at = with_text(docs, keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names, scores = [], []
            column = b.column(at).fill_null("")
            for p in probabilities(column, model):
                if p is None or not langs:
                    names.append("und"), scores.append(0.0)
                else:
                    best = int(np.argmax(p))
                    names.append(langs[best]), scores.append(min(1.0, float(p[best])))
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=[*keep, "lang_pred", "score"])

    fields = docs.select(*keep).schema.fields
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", lang_pred string, score double"
    return rows.mapInArrow(run, ddl)
