"""Language identification by prediction by partial matching.

Per language a context tree over bytes holds, for every context of up to ``max_order`` bytes, how
often each byte followed. A byte that a context has seen ``c`` times among ``n`` costs
``-log2(c / (n + q))`` bits, ``q`` being the number of different bytes seen there; any other byte
pays the escape ``-log2(q / (n + q))`` and is coded by the next shorter context, down to a uniform
code of 8 bits. Statistics are frozen after training, so the code length of a text is exact and
the same wherever it is computed; the language with the shortest code wins.

All languages share one numbering of the contexts they saw: the state after a byte comes from a
dense table, and one row per state holds the cost in every language. A text is scored with a few
table lookups per byte for all languages at once.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .shared import by_batch, crc_bucket, row_ranges, trim, utf8

UNDETERMINED = "und"


@dataclass
class PPM:
    """Frozen trees: ``steps[k]`` numbers the (k+2)-grams, ``cost[k]`` and ``escape[k]`` have a column per language."""

    langs: list[str]
    byte_class: np.ndarray
    n_classes: int
    steps: list[np.ndarray]
    cost: list[np.ndarray]
    escape: list[np.ndarray]

    @classmethod
    def fit(cls, samples: dict[str, list[bytes]], max_order: int = 3) -> PPM:
        langs = sorted(samples)
        texts = [[t for t in samples[name] if t] for name in langs]
        data = np.frombuffer(b"".join(t for own in texts for t in own), np.uint8)
        bounds = np.cumsum([0, *(sum(map(len, own)) for own in texts)])
        spans = list(zip(bounds[:-1], bounds[1:], strict=True))  # a language's bytes stand together
        starts = np.cumsum([0, *(len(t) for own in texts for t in own)])[:-1]
        # place in the text, where that is max_order or less; an earlier text's mark beyond its end is written over
        age = np.full(len(data), max_order + 1, np.uint16)
        for k in range(max_order, -1, -1):
            age[starts[starts + k < len(data)] + k] = k
        seen = np.flatnonzero(np.bincount(data, minlength=256))
        byte_class = np.zeros(256, np.int32)
        byte_class[seen] = np.arange(1, len(seen) + 1)
        n_classes, n_langs = len(seen) + 1, len(langs)

        # whole-sample arrays are 4 bytes an entry, wider ones live for one language at a time
        symbol = byte_class[data]
        gram, shorter, steps, cost, escape = symbol, None, [], [], []
        size = n_classes
        context = np.ones(len(data), np.int32)  # the empty context is number 1, "no context" is 0
        n_contexts, below = 2, np.full((1, n_langs), 8.0)  # below: cost without any context
        for order in range(max_order + 1):
            count = np.zeros((size, n_langs))
            parent = np.zeros(size, np.int32)
            suffix = np.zeros(size, np.int32)
            for i, (lo, hi) in enumerate(spans):
                live = np.flatnonzero(age[lo:hi] >= order) + lo
                count[:, i] = np.bincount(gram[live], minlength=size)
                parent[gram[live]] = context[live]
                if order:
                    suffix[gram[live]] = shorter[live]
            count[0] = 0
            total = np.zeros((n_contexts, n_langs))
            kinds = np.zeros((n_contexts, n_langs))
            np.add.at(total, parent, count)
            np.add.at(kinds, parent, count > 0)
            with np.errstate(divide="ignore", invalid="ignore"):
                leave = np.where(total > 0, -np.log2(kinds / (total + kinds)), 0.0)
                inside = -np.log2(count / (total + kinds)[parent])
            leave[0] = 0
            here = np.where(count > 0, inside, leave[parent] + below[suffix])
            here[0] = leave[1] + 8.0 if order == 0 else 0.0
            escape.append(leave)
            cost.append(here)
            below = here
            if order == max_order:
                break
            # number the grams that are one byte longer
            step = np.zeros(size * n_classes, np.int32)
            for lo, hi in spans:
                at = np.flatnonzero(age[lo:hi] > order) + lo
                step[gram[at - 1].astype(np.int64) * n_classes + symbol[at]] = 1
            kinds_of = np.flatnonzero(step)
            step[kinds_of] = np.arange(1, len(kinds_of) + 1)
            steps.append(step)
            longer = np.zeros(len(data), np.int32)
            context = np.zeros(len(data), np.int32)
            for lo, hi in spans:
                at = np.flatnonzero(age[lo:hi] > order) + lo
                longer[at] = step[gram[at - 1].astype(np.int64) * n_classes + symbol[at]]
                context[at] = gram[at - 1]
            n_contexts, size = size, len(kinds_of) + 1
            gram, shorter = longer, gram
        return cls(langs, byte_class, n_classes, steps, cost, escape)

    def code_lengths(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Bits of every row in every language."""
        n, rows = len(data), len(offsets) - 1
        out = np.zeros((rows, len(self.langs)))
        if n == 0 or not self.langs:
            return out
        starts = offsets[:-1][offsets[:-1] < offsets[1:]]
        symbol = self.byte_class[data]
        level, before = [symbol], [None]
        for step in self.steps:
            previous = np.empty_like(level[-1])
            previous[0] = 0
            previous[1:] = level[-1][:-1]
            previous[starts] = 0
            level.append(step[previous * np.int32(self.n_classes) + symbol])
            before.append(previous)
        total = self.cost[-1][level[-1]]
        at = np.flatnonzero(level[-1] == 0)
        order = len(level) - 1
        while order > 0 and len(at):
            # not seen after this context: pay its escape, go on with the shorter one
            total[at] += self.escape[order][before[order][at]]
            order -= 1
            here = level[order][at]
            known = here != 0 if order else np.ones(len(at), bool)
            total[at[known]] += self.cost[order][here[known]]
            at = at[~known]
        full = np.flatnonzero(offsets[:-1] < offsets[1:])
        out[full] = np.add.reduceat(total, offsets[full], axis=0)
        return out


def sample_training(docs: DataFrame, docs_per_lang: int, bytes_per_lang: int) -> dict[str, list[bytes]]:
    """At most ``docs_per_lang`` labelled texts with a letter, and at most ``bytes_per_lang`` bytes, a language.

    The choice is by a hash of doc_id over all labelled rows whose text has a letter. A text counts with
    its first sixteenth of ``bytes_per_lang``, so that a long one leaves room for others. The ranking
    keeps ``docs_per_lang`` rows of each map task (a group limit below the exchange) and moves no text;
    the driver gets the chosen parts, bounded by both parameters.
    """
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    labelled = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").rlike(r"\p{L}"))
    # first within 16 parts of each language, so that no task ranks the rows of a large language alone
    part = Window.partitionBy("lang", "part").orderBy(F.xxhash64("doc_id"), "doc_id")
    ranked = labelled.select("doc_id", "lang", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(16)).alias("part"))
    for window in (part, order):
        ranked = ranked.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= docs_per_lang).drop("rank")
    ids = [r[0] for r in ranked.select("doc_id").distinct().collect()]
    if not ids:
        return {}
    head = F.substring(F.col("text").cast("binary"), 1, max(bytes_per_lang // 16, 1))
    chosen = labelled.where(F.col("doc_id").isin(ids)).select("doc_id", "lang", head.alias("head"))
    chosen = chosen.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= docs_per_lang)
    used = F.sum(F.octet_length("head").cast("long")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    out: dict[str, list[bytes]] = {}
    for lang, head, used in chosen.withColumn("used", F.coalesce(used, F.lit(0))).where(F.col("used") < bytes_per_lang).orderBy("lang", "rank").select("lang", "head", "used").collect():
        out.setdefault(lang, []).append(bytes(head[: bytes_per_lang - used]))
    return out


def train(docs: DataFrame, docs_per_lang: int = 300, bytes_per_lang: int = 1 << 20, max_order: int = 3) -> PPM:
    """A model from the labelled rows of ``docs``; the bounds are those of ``sample_training``."""
    model = PPM.fit(sample_training(docs, docs_per_lang, bytes_per_lang), max_order)
    trim()
    return model


def identify(docs: DataFrame, model: PPM, text: str = "text", inside: str | None = None) -> DataFrame:
    """Add ``lang_pred``, ``score``, ``bits_per_byte`` and ``accepted`` to ``docs``.

    score is the posterior of the winning language under equal priors. A null, empty or letterless
    text, or any text when the model knows no language, gets ``und``, score 0 and is not accepted; every
    other text is. The rate decides nothing: capitals, digits and signs that the sample hardly holds cost
    more than 8 bits each, so a bound on it would drop short, capitalised and numeric texts of known
    languages. Ties go to the language that sorts first. Existing columns of these four names are replaced.
    With ``inside``, the text is that field of the struct column ``text``.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)  # bounded by the training bytes
    keep = [c for c in docs.columns if c not in ("lang_pred", "score", "bits_per_byte", "accepted")]
    docs = docs.select(keep)
    schema = StructType(docs.schema.fields[:]).add("lang_pred", "string").add("score", "double").add("bits_per_byte", "double").add("accepted", "boolean")

    def run(batches):
        ppm = shared.value
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(text))
            if inside is not None:
                column = column.field(inside)
            letters = np.asarray(pc.match_substring_regex(column, r"\p{L}").fill_null(False)) if len(column) else np.zeros(0, bool)
            data, offsets = utf8(column)
            bits = np.zeros((len(column), len(ppm.langs)))
            for a, b in row_ranges(offsets, 1 << 18):  # arrays of some 100 bytes a byte of text
                lo, hi = offsets[a], offsets[b]
                bits[a:b] = ppm.code_lengths(data[lo:hi], offsets[a : b + 1] - lo)
            size = np.maximum(np.diff(offsets), 1)
            if ppm.langs:
                best = bits.argmin(axis=1)
                least = bits.min(axis=1)
                score = 1 / np.exp2(-np.minimum(bits - least[:, None], 1000)).sum(axis=1)
                lang = np.array(ppm.langs, object)[best]
            else:
                letters[:] = False
                least, score, lang = np.zeros(len(column)), np.zeros(len(column)), np.full(len(column), None, object)
            added = [pa.array(np.where(letters, lang, UNDETERMINED), pa.string()), pa.array(np.where(letters, score, 0.0)), pa.array(least / size), pa.array(letters)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], names=[*keep, "lang_pred", "score", "bits_per_byte", "accepted"])

    return docs.mapInArrow(by_batch(run), schema)


def op1_language_id(docs: DataFrame) -> DataFrame:
    """Train on the labelled rows outside the held-out quarter, predict every row."""
    model = train(docs.where(F.coalesce(crc_bucket(4) != 2, F.lit(False))))
    rows = docs.select("doc_id", "text", F.coalesce(crc_bucket(4) == 2, F.lit(False)).alias("held_out"))
    return identify(rows, model).select("doc_id", "held_out", "lang_pred", "score", "bits_per_byte", "accepted")
