"""Language identification by interpolated Kneser-Ney character models, one for each language.

Words (runs of letters; lower case) are padded, and 4-grams of characters inside a word are counted over all
learning documents. Orders 1 to 3 use continuation counts; each order has its own absolute discount n1 / (n1 + 2
n2). A model is stored as sorted arrays of the 64-bit hashes of its n-grams and contexts, with their weights: 16 bytes
for each distinct n-gram of a language's words, which grow far slower than the corpus. A text gets the language of lowest cross-entropy per character. The score is a softmax of the
entropies whose scale is calibrated on all learning documents. A text is rejected if its best entropy lies far above
the median of that language's learning documents, counted in a histogram over all of them; medians and quantiles, so
that a few odd or mislabelled documents don't move the limit.

Cases: null text, or one without a letter: ``und``, score 0, rejected. Equal texts get equal results; a tie goes
to the language that sorts first. Rows with null language aren't learned from. With no language learned every
text is ``und``. An empty table gives an empty result. Other columns pass through, but for those named like a result,
which give way to it (with ``into`` the results are one struct of that name, and every column stays).
"""

from __future__ import annotations

import dataclasses
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logloom.llm import tables
from logloom.llm import textblocks as tb

ORDER = 4
START, END = 2, 3
_GRAM, _CONTEXT = 0, 1
_LETTER = np.zeros(256, bool)
_LETTER[list(range(97, 123))] = True
_LETTER[128:] = True


@dataclasses.dataclass(frozen=True)
class Settings:
    #: A text is rejected beyond the median entropy of its language's learning documents plus so many times their spread
    #: (from the median to the quantile one standard deviation above it), and beyond ``slack`` times that median; and
    #: beyond all but a hundredth of them.
    spreads: float = 8.0
    slack: float = 2.0


#: Work arrays take some thirty times a block.
BLOCK_BYTES = 2 << 20
#: Candidates for the softmax scale, and bins of the entropy histogram in a bit (an entropy is below 40 bits).
SCALES = (0.5, 1, 2, 4, 8, 16, 32)
BINS = 256


class _Grams:
    """4-grams of the distinct words of a block. grams: code points (n, 4); word: the word of each."""

    def __init__(self, column: pa.Array):
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        data, at = tb.flat(pc.utf8_lower(column.cast(pa.large_string())))
        inside = _LETTER[data]
        begins = tb.doc_starts(data, at)[:-1]
        starts = inside.copy()
        starts[1:] &= ~inside[:-1] | begins[1:]
        where = np.flatnonzero(starts)
        self.first = np.searchsorted(where, at)
        rank = np.cumsum(inside, dtype=np.int32 if len(inside) < 1 << 31 else np.int64)
        letters = data[inside]
        self.codes, words = tb.encoded(letters, np.append(rank[where].astype(np.int64) - 1, len(letters)))
        raw, ends = tb.flat(words)
        points = np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        size = tb.per_text(~tb.IS_TAIL[raw], ends)
        n, pad = len(size), ORDER - 1
        led = np.cumsum(size + pad + 1) - (size + pad + 1)
        row = np.full(int((size + pad + 1).sum()), START, np.uint32)
        place = np.repeat(led + pad - (np.cumsum(size) - size), size) + np.arange(len(points))
        row[place] = points
        row[led + pad + size] = END
        self.size = size + 1
        target = np.repeat(led + pad - (np.cumsum(self.size) - self.size), self.size) + np.arange(int(self.size.sum()))
        self.grams = np.stack([row[target - k] for k in range(pad, -1, -1)], axis=1)
        self.word = np.repeat(np.arange(n), self.size)

    def texts(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def _hashes(grams: np.ndarray) -> np.ndarray:
    """64-bit hash of each row of code points; rows of different lengths never share a chain."""
    out = np.full(len(grams), grams.shape[1], np.uint64)
    for k in range(grams.shape[1]):
        out = tb.mixed(out * np.uint64(0x100000001B3) + grams[:, k].astype(np.uint64))
    return out


def gram_counts(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    """lang, gram, n over all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in tb.blocks(batch, 0, BLOCK_BYTES):
                langs = rows.column(1).dictionary_encode()
                names, lang = langs.dictionary.to_pylist(), langs.indices.to_numpy()
                found = _Grams(rows.column(0))
                if not len(found.codes):
                    continue
                pair, n = np.unique(found.codes.astype(np.int64) * len(names) + lang[found.texts()], return_counts=True)
                word, word_lang = pair // len(names), pair % len(names)
                first = np.cumsum(found.size) - found.size
                index = tb.ragged(np.arange(len(found.grams)), first[word], found.size[word])
                of, weight = np.repeat(word_lang, found.size[word]), np.repeat(n, found.size[word])
                key = tb.mixed(_hashes(found.grams)[index] + of.astype(np.uint64))
                _, one, inverse = np.unique(key, return_index=True, return_inverse=True)
                total = np.bincount(inverse, weights=weight).astype(np.int64)
                text = np.ascontiguousarray(found.grams[index[one]], "<u4").view(f"<U{ORDER}").ravel().tolist()
                yield pa.RecordBatch.from_arrays([pa.array([names[i] for i in of[one].tolist()], pa.string()), pa.array(text, pa.string()), pa.array(total)], ["lang", "gram", "n"])

    return docs.select(text_col, lang_col).mapInArrow(run, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


@dataclasses.dataclass
class Model:
    langs: list[str]
    #: (language, order) -> sorted hashes of n-grams with their discounted share, and of contexts with their back-off weight.
    grams: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]]
    contexts: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]]
    #: Chance of a character that no order has seen, by language.
    floor: np.ndarray
    scale: float = 10.0
    limit: np.ndarray | None = None

    def entropy(self, grams: np.ndarray) -> np.ndarray:
        """Bits of each gram's last character, by language."""
        out = np.empty((len(grams), len(self.langs)))
        keys = {n: (_hashes(grams[:, ORDER - n :]), _hashes(grams[:, ORDER - n : -1])) for n in range(1, ORDER + 1)}

        def look(stored: tuple[np.ndarray, np.ndarray] | None, key: np.ndarray, missing: float) -> np.ndarray:
            if stored is None or not len(stored[0]):
                return np.full(len(key), missing)
            at = np.minimum(np.searchsorted(stored[0], key), len(stored[0]) - 1)
            return np.where(stored[0][at] == key, stored[1][at], missing)

        for i in range(len(self.langs)):
            p = np.full(len(grams), self.floor[i])
            for n in range(1, ORDER + 1):
                gram, context = keys[n]
                p = look(self.grams.get((i, n)), gram, 0.0) + look(self.contexts.get((i, n)), context, 1.0) * p
            out[:, i] = -np.log2(np.maximum(p, 1e-12))
        return out

    def measure(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Bits per character of each text by language, and its characters."""
        found = _Grams(column)
        n_texts = len(found.first) - 1
        if not len(found.codes):
            return np.zeros((n_texts, len(self.langs))), np.zeros(n_texts, np.int64)
        _, one, inverse = np.unique(_hashes(found.grams), return_index=True, return_inverse=True)
        bits = self.entropy(found.grams[one])
        first = np.cumsum(found.size) - found.size
        chars = np.concatenate(([0], np.cumsum(found.size[found.codes])))
        chars = chars[found.first[1:]] - chars[found.first[:-1]]
        out = np.empty((n_texts, len(self.langs)))
        for i in range(len(self.langs)):
            by_word = np.add.reduceat(bits[inverse, i], first)
            out[:, i] = np.bincount(found.texts(), weights=by_word[found.codes], minlength=n_texts)
        return out / np.maximum(chars, 1)[:, None], chars

    def predict(self, column: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Language, score, bits per character and whether the text is rejected."""
        n = len(column)
        if not self.langs:
            return ["und"] * n, np.zeros(n), np.zeros(n), np.ones(n, bool)
        bits, chars = self.measure(column)
        best = bits.argmin(axis=1)
        low = bits[np.arange(n), best]
        score = 1 / np.exp(-self.scale * (bits - low[:, None])).sum(axis=1)
        some = chars > 0
        plain = pc.fill_null(pc.match_substring_regex(column, "[A-Za-z]"), False).to_numpy(zero_copy_only=False)
        for row in np.flatnonzero(some & ~plain):  # bytes beyond ASCII need not be letters
            some[row] = any(map(str.isalpha, set(column[int(row)].as_py())))
        rejected = ~some | (low > (self.limit[best] if self.limit is not None else np.inf))
        return [self.langs[b] if ok else "und" for b, ok in zip(best.tolist(), some.tolist(), strict=True)], np.where(some, score, 0.0), low, rejected


def _model_rows(counts: DataFrame) -> tuple[DataFrame, dict]:
    """place (language, order and kind in one number), key, value: one row an n-gram or context. And the numbers of characters."""
    tables_by_order = {ORDER: counts.select("lang", "gram", F.col("n").cast("double").alias("c"))}
    for n in range(ORDER - 1, 0, -1):
        tail = F.expr(f"substring(gram, 2, {n})")
        tables_by_order[n] = tables_by_order[n + 1].groupBy("lang", tail.alias("gram")).agg(F.count("*").cast("double").alias("c"))
    spread = None
    for n, df in tables_by_order.items():
        part = df.groupBy("lang").agg(F.count_if(F.col("c") == 1).alias("n1"), F.count_if(F.col("c") == 2).alias("n2"), F.count("*").alias("types")).withColumn("n", F.lit(n))
        spread = part if spread is None else spread.unionByName(part)
    stats = {(r.lang, r.n): r for r in spread.collect()}  # a row for each language and order
    langs = {lang: i for i, lang in enumerate(sorted({lang for lang, _ in stats}))}
    number = F.create_map(*[F.lit(x) for pair in langs.items() for x in pair])[F.col("lang")] if langs else F.lit(0)
    rows = None
    for n, df in tables_by_order.items():
        d = {lang: max(0.1, min(0.95, r.n1 / (r.n1 + 2 * r.n2) if r.n1 else 0.5)) for (lang, m), r in stats.items() if m == n}
        discount = F.create_map(*[F.lit(x) for pair in d.items() for x in pair])[F.col("lang")] if d else F.lit(0.5)
        context = F.expr(f"substring(gram, 1, {n - 1})").alias("context")
        by_context = df.groupBy("lang", context).agg(F.sum("c").alias("total"), F.count("*").alias("types"))
        joined = df.withColumn("context", context).join(by_context, ["lang", "context"])
        place = lambda kind, n=n: ((number * ORDER + (n - 1)) * 2 + kind).cast("int").alias("place")
        grams = joined.select(place(_GRAM), "gram", ((F.col("c") - discount) / F.col("total")).alias("value"))
        contexts = by_context.select(place(_CONTEXT), F.col("context").alias("gram"), (discount * F.col("types") / F.col("total")).alias("value"))
        part = grams.unionByName(contexts)
        rows = part if rows is None else rows.unionByName(part)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column(1).to_pylist()
            size = np.fromiter(map(len, text), np.int64, len(text))
            key = np.zeros(len(text), np.int64)
            for k in np.unique(size):
                some = np.flatnonzero(size == k)
                grams = np.array([text[i] for i in some], f"<U{max(k, 1)}").view("<u4").reshape(len(some), max(k, 1))[:, :k]
                key[some] = _hashes(grams).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(key), batch.column(2)], ["place", "key", "value"])

    return rows.mapInArrow(run, "place int, key long, value double"), {lang: r.types for (lang, m), r in stats.items() if m == 1}


def train(docs: DataFrame, learn: Column, settings: Settings = Settings(), text_col: str = "text", lang_col: str = "lang") -> Model:
    """The model of the rows where ``learn`` holds and the language is known."""
    rows = docs.where(learn & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(text_col, lang_col)
    counts = tables.written(gram_counts(rows, text_col, lang_col), "language-grams")
    table, characters = _model_rows(counts)
    got = table.toArrow()
    langs = sorted(characters)
    place, key, value = (got[c].to_numpy() for c in ("place", "key", "value"))
    del got
    order = np.lexsort((key.view(np.uint64), place))
    place, key, value = place[order], key.view(np.uint64)[order], value[order]
    edge = np.searchsorted(place, np.arange(len(langs) * ORDER * 2 + 1))
    part = lambda i, n, kind: slice(*edge[((i * ORDER + n - 1) * 2 + kind) + np.array([0, 1])].tolist())
    stores = [{(i, n): (key[part(i, n, kind)], value[part(i, n, kind)]) for i in range(len(langs)) for n in range(1, ORDER + 1)} for kind in (_GRAM, _CONTEXT)]
    everything = max(characters.values(), default=0) + 1
    model = Model(langs, *stores, np.full(len(langs), 1 / (2.0 * everything)))
    _calibrate(model, rows, settings, text_col, lang_col)
    return model


def _calibrate(model: Model, rows: DataFrame, settings: Settings, text_col: str, lang_col: str) -> None:
    """Scale and rejection limits from all rows: a histogram of own entropies by language, and the loss of each scale."""
    if not model.langs:
        return
    shipped = rows.sparkSession.sparkContext.broadcast(model)
    names = ["lang", "bin", "n", *[f"loss{k}" for k in range(len(SCALES))]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = {name: i for i, name in enumerate(shipped.value.langs)}
        for batch in batches:
            for part in tb.blocks(batch, 1, BLOCK_BYTES):
                bits, chars = shipped.value.measure(part.column(1))
                some = np.flatnonzero(chars > 0)
                if not len(some):
                    continue
                bits, truth = bits[some], np.array([place[x] for x in part.column(0).to_pylist()])[some]
                own = bits[np.arange(len(bits)), truth]
                cell, inverse, n = np.unique(truth * (40 * BINS) + (own * BINS).astype(np.int64), return_inverse=True, return_counts=True)
                sums = []
                for scale in SCALES:
                    odds = -scale * (bits - bits.min(axis=1, keepdims=True))
                    loss = np.log(np.exp(odds).sum(axis=1)) - odds[np.arange(len(odds)), truth]
                    sums.append(np.bincount(inverse, weights=np.rint(loss * 1e6)).astype(np.int64))  # whole numbers: any order gives one sum
                lang = pa.array([shipped.value.langs[i] for i in (cell // (40 * BINS)).tolist()], pa.string())
                yield pa.RecordBatch.from_arrays([lang, *map(pa.array, (cell % (40 * BINS), n, *sums))], names)

    found = rows.select(lang_col, text_col).mapInArrow(run, "lang string, " + ", ".join(f"{c} long" for c in names[1:]))
    got = found.groupBy("lang", "bin").agg(*[F.sum(c).alias(c) for c in names[2:]]).toArrow()
    model.limit = np.full(len(model.langs), np.inf)
    if not got.num_rows:
        return
    columns = {c: got[c].to_numpy(zero_copy_only=False) for c in names}
    model.scale = SCALES[int(np.argmin([sum(columns[c].tolist()) for c in names[3:]]))]
    for i, name in enumerate(model.langs):
        mine = np.flatnonzero(columns["lang"] == name)
        if len(mine):
            mine = mine[np.argsort(columns["bin"][mine])]
            below = np.cumsum(columns["n"][mine])
            middle, above, high = ((columns["bin"][mine][np.searchsorted(below, q * below[-1])] + 1) / BINS for q in (0.5, 0.8413, 0.99))
            model.limit[i] = max(middle + settings.spreads * (above - middle), settings.slack * middle, high)


def identify(docs: DataFrame, model: Model, text_col: str = "text", keep: list[str] | None = None, into: str | None = None) -> DataFrame:
    """The named columns (all by default), with lang_pred, score, bits_per_char and rejected, or a struct of them."""
    fields = [T.StructField(n, t) for n, t in (("lang_pred", T.StringType()), ("score", T.DoubleType()), ("bits_per_char", T.DoubleType()), ("rejected", T.BooleanType()))]
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def made(texts: pa.Array) -> list[pa.Array]:
        lang, *rest = shipped.value.predict(texts)
        return [pa.array(lang, pa.string()), *map(pa.array, rest)]

    return tables.extended(docs, text_col, docs.columns if keep is None else keep, fields, made, into, BLOCK_BYTES)
