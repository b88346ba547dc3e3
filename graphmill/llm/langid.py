"""Language identification by a byte convolutional network trained in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphmill.llm.common import fresh, if_small, map_rows, pieces_of

#: Bytes of a window; filter widths and filters of each.
WINDOW, WIDTHS, FILTERS = 512, (2, 3, 4), 8
#: Labelled texts that training draws for each language, and of all languages together, at most; one of each at least.
PER_LANGUAGE, WINDOWS = 600, 300_000
#: Labels that are learned at most.
LANGUAGES = 10_000
#: Positions that are convolved at a time, so that the activations stay in the processor's cache.
BLOCK = 1 << 14
UNDETERMINED = "und"
LETTER = regex.compile(r"\p{L}")
#: A-Z as a-z, other bytes as they are.
FOLD = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)


@dataclass
class ByteConv:
    """kernels[w][j][b] holds what byte b at offset j adds to each filter of width w; a filter's maximum over a
    window, floored at zero, feeds the softmax."""

    names: list[str]
    kernels: list[np.ndarray]
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray

    def tables(self) -> tuple[np.ndarray, np.ndarray]:
        """The kernels as sums over byte pairs: one table for offsets 0 and 1, one for offsets 2 and 3."""
        low, high = np.divmod(np.arange(1 << 16), 256)
        n = FILTERS * len(WIDTHS)
        first, second = np.zeros((1 << 16, n), np.float32), np.zeros((1 << 16, n), np.float32)
        for k, (w, kernel) in enumerate(zip(WIDTHS, self.kernels, strict=True)):
            at = slice(k * FILTERS, (k + 1) * FILTERS)
            first[:, at] = kernel[0][low] + kernel[1][high] + self.bias[at]
            second[:, at] = (kernel[2][low] if w > 2 else 0) + (kernel[3][high] if w > 3 else 0)
        return first, np.ascontiguousarray(second[:, FILTERS:])


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(windows: list[bytes], labels: np.ndarray, names: list[str], rounds: int = 10, batch: int = 64, rate: float = 0.01, seed: int = 3) -> ByteConv:
    """Adam on the cross-entropy; of each window a random part of 16 bytes or more is shown in every round, so that
    short texts are learned, too. A filter's gradient goes to the bytes under its maximum alone."""
    draw = np.random.default_rng(seed)
    n = FILTERS * len(WIDTHS)
    weights = [draw.normal(0, 0.3, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS]
    weights += [np.zeros(n, np.float32), draw.normal(0, 0.3, (n, len(names))).astype(np.float32), np.zeros(len(names), np.float32)]
    moments = [(np.zeros_like(w), np.zeros_like(w)) for w in weights]
    step = 0
    for _ in range(rounds):
        order = draw.permutation(len(windows))
        for at in range(0, len(order), batch):
            rows = order[at : at + batch]
            shown = []
            for r in rows:
                size = min(len(windows[r]), int(16 * (WINDOW / 16) ** draw.random()))
                begin = int(draw.integers(0, len(windows[r]) - size + 1))
                shown.append(windows[r][begin : begin + size])
            width = max(map(len, shown))
            x = np.zeros((len(rows), width + 3), np.uint8)
            for i, s in enumerate(shown):
                x[i, : len(s)] = FOLD[np.frombuffer(s, np.uint8)]
            live = np.arange(width)[None] < np.array([max(1, len(s)) for s in shown])[:, None]
            tops, where = [], []
            for k, w in enumerate(WIDTHS):
                z = sum(weights[k][j][x[:, j : j + width]] for j in range(w))
                z = np.where(live[..., None], z, -1e9)
                where.append(z.argmax(axis=1))
                tops.append(np.take_along_axis(z, where[-1][:, None], axis=1)[:, 0])
            pooled = np.concatenate(tops, axis=1) + weights[-3]
            hidden = np.maximum(pooled, 0)
            miss = softmax(hidden @ weights[-2] + weights[-1])
            miss[np.arange(len(rows)), labels[rows]] -= 1
            miss /= len(rows)
            back = (miss @ weights[-2].T) * (pooled > 0)
            grads = [np.zeros_like(w) for w in weights]
            for k, w in enumerate(WIDTHS):
                part = back[:, k * FILTERS : (k + 1) * FILTERS]
                for j in range(w):
                    np.add.at(grads[k][j], (x[np.arange(len(rows))[:, None], where[k] + j], np.arange(FILTERS)[None]), part)
            grads[-3], grads[-2], grads[-1] = back.sum(axis=0), hidden.T @ miss, miss.sum(axis=0)
            step += 1
            for w, g, (a, b) in zip(weights, grads, moments, strict=True):
                a += 0.1 * (g - a)
                b += 0.001 * (g * g - b)
                w -= rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-6)
    return ByteConv(names, weights[: len(WIDTHS)], weights[-3], weights[-2], weights[-1])


class Reader:
    """A network ready to read texts."""

    def __init__(self, net: ByteConv):
        self.net = net
        self.first, self.second = net.tables()

    def pooled(self, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Each filter's maximum from each start to the next; data has three more bytes at its end."""
        n = len(data) - 3
        out = np.full((len(starts), FILTERS * len(WIDTHS)), -np.inf, np.float32)
        for begin in range(0, n, BLOCK):
            end = min(n, begin + BLOCK)
            pairs = (data[begin : end + 2].astype(np.int32) << 8) | data[begin + 1 : end + 3]
            z = self.first[pairs[:-2]]
            z[:, FILTERS:] += self.second[pairs[2:]]
            low, high = np.searchsorted(starts, begin, "right") - 1, np.searchsorted(starts, end, "left")
            cuts = np.maximum(starts[low:high] - begin, 0)
            out[low:high] = np.maximum(out[low:high], np.maximum.reduceat(z, cuts, axis=0))
        return out

    def read(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The class and its probability for each text: the mean over its windows, weighted by their bytes."""
        sizes = np.array([max(1, len(t)) for t in texts])
        data = np.frombuffer(b"".join(t + bytes(s - len(t) + 3) for t, s in zip(texts, sizes.tolist(), strict=True)), np.uint8)
        base = np.concatenate([[0], np.cumsum(sizes + 3)[:-1]])
        counts = -(-sizes // WINDOW)
        doc = np.repeat(np.arange(len(texts)), counts)
        within = np.arange(len(doc)) - np.repeat(np.cumsum(counts) - counts, counts)
        length = np.minimum(WINDOW, sizes[doc] - within * WINDOW)
        # A text's window and, past its last byte, the gap to the next text, which is dropped again.
        starts = np.sort(np.concatenate([base[doc] + within * WINDOW, base + sizes]))
        top = self.pooled(np.concatenate([FOLD[data], np.zeros(3, np.uint8)]), starts)[np.searchsorted(starts, base[doc] + within * WINDOW)]
        odds = softmax(np.maximum(top, 0) @ self.net.out + self.net.out_bias) * length[:, None]
        mean = np.add.reduceat(odds, np.cumsum(counts) - counts, axis=0) / sizes[:, None]
        best = mean.argmax(axis=1)
        return best, np.clip(mean[np.arange(len(texts)), best], 0, 1)


def held_out(id_col: str, folds: int) -> Column:
    return F.coalesce((F.crc32(F.col(id_col).cast("string")) % folds) == 0, F.lit(False))


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> ByteConv | None:
    """A network for all languages of docs, from one window each of a bounded sample: of every language as many distinct
    texts, up to PER_LANGUAGE, as come first by a hash; WINDOWS in all. Of more than LANGUAGES labels the most frequent are
    learned, ties by name. None if no row is labelled."""
    labelled = docs.where(F.col(lang_col).isNotNull() & (F.octet_length(text_col) > 0)).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    place = F.pmod(F.xxhash64("text", F.lit(2)), F.lit(1 << 40))
    known = labelled.groupBy("lang").agg(F.approx_count_distinct(place).alias("n"), F.count("*").alias("rows"))
    counts = {r["lang"]: r["n"] for r in known.orderBy(F.desc("rows"), "lang").limit(LANGUAGES).collect()}
    if not counts:
        return None
    each = max(1, min(PER_LANGUAGE, WINDOWS // len(counts)))
    # Enough for `each` texts, estimates and chance allowed for; the rest never leaves its task.
    shares = [(k, int((1 << 40) * min(1.0, (1.3 * each + 30) / n))) for k, n in counts.items()]
    bounds = if_small(docs.sparkSession.createDataFrame(shares, "lang string, bound long"), len(shares), 40)
    data, spare = F.col("text").cast("binary"), F.greatest(F.octet_length("text") - WINDOW, F.lit(0))
    begin = F.pmod(F.xxhash64("text", F.lit(1)), spare + 1).cast("int") + 1
    drawn = labelled.join(bounds, "lang").where(place < F.col("bound")).select("lang", place.alias("h"), F.substring(data, begin, F.lit(WINDOW)).alias("window"))
    kept: dict[str, list[bytes]] = {k: [] for k in sorted(counts)}
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h", "window"))
    first = drawn.distinct().withColumn("rank", rank).where(F.col("rank") <= each)
    for r in sorted(first.collect(), key=lambda r: (r["lang"], r["h"], bytes(r["window"]))):
        kept[r["lang"]].append(bytes(r["window"]))
    names = [k for k in kept if kept[k]]
    return train([w for k in names for w in kept[k]], np.repeat(np.arange(len(names)), [len(kept[k]) for k in names]), names)


def predict(docs: DataFrame, net: ByteConv | None, text: Column, keep: list[Column], lang_name: str = "lang_pred", score_name: str = "score") -> DataFrame:
    """The columns `keep` of docs, then the language and score of each whole text, all windows of which are read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        reader = Reader(net) if net else None
        for batch in pieces_of(batches):
            texts = batch.column(batch.num_columns - 1).to_pylist()
            lang, score = [UNDETERMINED] * len(texts), np.zeros(len(texts))
            asked = [i for i, t in enumerate(texts) if reader and t and LETTER.search(t)]
            while asked and reader:
                n, size = 0, 0
                while n < len(asked) and (n == 0 or size < 1 << 20):
                    size += len(texts[asked[n]])
                    n += 1
                part, asked = asked[:n], asked[n:]
                best, odds = reader.read([texts[i].encode() for i in part])
                for i, b in zip(part, best.tolist(), strict=True):
                    lang[i] = reader.net.names[b]
                score[part] = odds
            yield dict(zip(names, batch.columns[:-1], strict=True)) | {lang_name: lang, score_name: score}

    rows = docs.select(*keep, text.cast("string").alias(fresh(docs.select(*keep), "text")[0]))
    names = rows.columns[:-1]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return map_rows(rows, f"{schema}, `{lang_name}` string, `{score_name}` double", run)


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 5) -> DataFrame:
    """(id, held_out, lang_pred, score) for every row of docs; learned from rows with a label whose id is not in the
    held-out fold, crc32(id as text) mod folds = 0. Predictions see the text alone.

    Null texts and texts without a letter are UNDETERMINED with score 0, and so is every text if no row is labelled.
    Null ids count as not held out. Repeated rows give rows of their own, ties go to the language that sorts first. An
    empty table gives an empty result. Other columns are ignored.
    """
    net = fit(docs.where(~held_out(id_col, folds)), text_col, lang_col)
    return predict(docs, net, F.col(text_col), [F.col(id_col), held_out(id_col, folds).alias("held_out")])
