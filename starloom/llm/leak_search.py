"""Evaluation texts leaking into training text: a distributed positional inverted index.

1. build_index stores the postings of every document: its distinct words with their positions among the words that are
   spoken in it (cue numbers, times, markup, noises and adverts take no position).  The index is partitioned by document,
   knows nothing of any test set and can be searched for many of them; each search reads the index and no text.
2. The document frequency of the item terms is counted, and each item takes its rarest terms as anchors until they hold more
   than half of the weight of every stretch that could count.  An item word weighs the more the fewer items have it.  So any
   passage that counts has an anchor, whatever the corpus holds: the frequency sets only the order.
3. Only documents with an anchor of an item, and with words enough for one of its stretches, are looked at for that item.
   Anchor positions are intersected with those of the other terms after subtracting the offsets in the item: hits of one
   passage agree in the adjusted position up to the words that were put in or lost.
4. Candidates are aligned in order; exact phrases and proximity matches are told apart by the positions.
5. The words of a passage are weighed again by the documents that have them outside the passages found: stock phrases that
   few items use are common there, the names and facts of an item are not, however often it was copied.  So texts of like
   wording with other facts drop out, and with none of them unless an unbroken half of the item stands there.

Items with the same words are searched once and reported under each of their ids.  Items of fewer than SHORT words count
only where they stand whole and word for word.  A test set of more than BLOCK_WORDS words is searched in blocks of items
over the same index, so what is broadcast is bounded and no item is left out.  Texts are processed whole and no document,
item or candidate is capped.  A null or empty text has no postings; items without words match nothing; repeated documents
are found under each of their ids.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import reduce
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starloom.llm.passages import best_passage
from starloom.llm.subtitles import fold, spoken_parts, words
from starloom.plans.durable import spread, stored

SHARE = 0.48  # at least half of an item, less a word lost at an end; a quote of a third is no leak
DENSITY = 0.68  # part of the words of a passage that must match; the rest may be misspelt or missing
WEIGHT_DENSITY = 0.6  # part of the weight of a passage that must match: names and facts, not only the common words
FACT_DENSITY = 0.45  # the same with words weighing less that are common outside the passages; one of two names may be misspelt
LEAST_FACTS = 0.1  # part of that weight of the whole item that a broken passage holds; one name is about so much, stock phrases less
CLOSE_STEPS = 0.5  # part of the steps of a passage that go to one of the next two item words within four positions
DRIFT = 10  # positions that a passage takes for each item word at most: CLOSE_STEPS of its steps are 4 long, the others 16
SHORT = 5  # items of fewer words count only whole and word for word
BLOCK_WORDS = 2_000_000  # item words that are searched, and broadcast, at once
SQUARE = 200  # items up to so many words have all their stretches compared at once
APART = 1000  # positions between the spoken words and those of lines in another script


def item_blocks(items: DataFrame, item: str, text: str) -> Iterator[dict[int, list[str]]]:
    """Words of each item, in order, in blocks of items of about BLOCK_WORDS words together."""
    found, total = {}, 0
    for row in items.select(item, text).toLocalIterator():
        found[row[0]] = words(fold(row[1] or ""))
        total += len(found[row[0]])
        if total >= BLOCK_WORDS:
            yield found
            found, total = {}, 0
    if found:
        yield found


def _least(length: int) -> int:
    """Words from the first to the last of the shortest passage that counts; below SHARE it is a half that lost its end word."""
    if length < SHORT:
        return length
    return min(math.ceil(SHARE * length - 1e-9), max((length + 1) // 2 - 1, length // 3 + 1))


def _can_fill(present: np.ndarray, weights: np.ndarray) -> bool:
    """Whether some stretch of an item has enough words and weight among the present ones (a bound that no passage escapes)."""
    size = _least(len(present))
    if size == len(present):
        return bool(present.all())
    words_over = np.concatenate(([0.0], np.cumsum(present - DENSITY)))
    weight_over = np.concatenate(([0.0], np.cumsum(weights * (present - WEIGHT_DENSITY))))
    if len(present) <= SQUARE:
        rising = (words_over[None, :] >= words_over[:, None] - 1e-6) & (weight_over[None, :] >= weight_over[:, None] - 1e-6)
        return bool(np.triu(rising, size).any())
    for start in range(len(present) - size + 1):
        if ((words_over[start + size :] >= words_over[start] - 1e-6) & (weight_over[start + size :] >= weight_over[start] - 1e-6)).any():
            return True
    return False


class TestVocabulary:
    """Term numbers of a block of items, the weight of each term, and the distinct items (sequences) with the ids that share them."""

    def __init__(self, terms: dict[int, list[str]]) -> None:
        members: dict[tuple[str, ...], list[int]] = defaultdict(list)
        for item, ws in terms.items():
            if ws:
                members[tuple(ws)].append(item)
        self.members = list(members.values())
        self.terms = sorted({w for ws in members for w in ws})
        number = {w: n for n, w in enumerate(self.terms)}
        self.sequences = [np.array([number[w] for w in ws]) for ws in members]
        spread = Counter(t for ts in self.sequences for t in set(ts.tolist()))
        self.weight = np.array([math.log1p(len(self.sequences) / spread[t]) ** 3 for t in range(len(number))])
        self.least_words = [DENSITY * _least(len(ts)) for ts in self.sequences]

    def anchors(self, item: int, frequency: dict[int, int]) -> set[int]:
        """The rarest terms of an item by document frequency that no passage that counts can do without."""
        sequence = self.sequences[item]
        order = sorted(set(sequence.tolist()), key=lambda t: (frequency.get(t, 0), t))
        low, high = 1, len(order)
        while low < high:
            middle = (low + high) // 2
            if _can_fill((~np.isin(sequence, order[:middle])).astype(float), self.weight[sequence]):
                low = middle + 1
            else:
                high = middle
        return set(order[:low])


def build_index(documents: DataFrame, doc: str, text: str) -> DataFrame:
    """The positional index (doc, terms, counts, positions): per document its distinct words, how often each occurs and where.

    positions holds the places of the first term, then of the second and so on.  Documents without words have no row.
    """
    kind = documents.schema[doc].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, terms, counts, places, ends, place_ends = [], [], [], [], [0], [0]
            for key, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                main, aside = spoken_parts(body)
                where: dict[str, list[int]] = defaultdict(list)
                n = 0
                for n, w in enumerate(words(main), 1):
                    where[w].append(n - 1)
                if aside:
                    for p, w in enumerate(words(aside), n + APART):
                        where[w].append(p)
                if where:
                    ids.append(key)
                    for w, at in where.items():
                        terms.append(w)
                        counts.append(len(at))
                        places += at
                    ends.append(len(terms))
                    place_ends.append(len(places))
            offsets, place_offsets = pa.array(ends, pa.int32()), pa.array(place_ends, pa.int32())
            lists = [
                pa.ListArray.from_arrays(offsets, pa.array(terms, pa.string())),
                pa.ListArray.from_arrays(offsets, pa.array(counts, pa.int32())),
                pa.ListArray.from_arrays(place_offsets, pa.array(places, pa.int32())),
            ]
            yield pa.RecordBatch.from_arrays([pa.array(ids, batch.column(0).type), *lists], ["doc", "terms", "counts", "positions"])

    source = documents.select(F.col(doc).alias("doc"), F.col(text).alias("text")).filter("text is not null")
    return spread(source).mapInArrow(run, f"doc {kind}, terms array<string>, counts array<int>, positions array<int>")


def document_frequencies(index: DataFrame, vocabulary: TestVocabulary) -> dict[int, int]:
    """Documents per term number; at most one entry per distinct word of the block of items."""
    spark = index.sparkSession
    numbered = spark.createDataFrame(list(enumerate(vocabulary.terms)), "number int, term string")
    counted = (
        index.select(F.explode("terms").alias("term"))
        .join(F.broadcast(numbered), "term")  # at most BLOCK_WORDS words
        .groupBy("number")
        .agg(F.count(F.lit(1)).alias("df"))
    )
    return {row["number"]: row["df"] for row in counted.toLocalIterator()}


def _close(places: list[int], place: int, reach: int) -> bool:
    """Whether one of the sorted places is within reach."""
    k = bisect_left(places, place - reach)
    return k < len(places) and places[k] <= place + reach


def _passage(
    where: dict[int, list[int]], sequence: list[int], anchored: set[int], weight: list[float]
) -> tuple[int, int, list[int], str] | None:
    """(first offset, last offset, matched terms, kind) of the best passage of an item in a document's words, if it can count."""
    length = len(sequence)
    near = sorted(p - o for o, t in enumerate(sequence) if t in anchored for p in where.get(t, ()))
    heaviest = max(weight[t] for t in sequence)
    names = {o for o, t in enumerate(sequence) if weight[t] >= heaviest / 2}
    hits = [(p, o) for o, t in enumerate(sequence) for p in where.get(t, ()) if _close(near, p - o, DRIFT * length)]
    first, last, chain = best_passage(hits, names)
    span = last - first + 1
    if not chain:
        return None
    run = longest = 1
    for (p, o), (q, r) in pairwise(chain):
        run = run + 1 if q - p == 1 and r - o == 1 else 1
        longest = max(longest, run)
    kind = "exact" if longest == length else "phrase" if longest >= _least(length) else "proximity"
    terms = [sequence[o] for _, o in chain]
    if length < SHORT:
        return (first, last, terms, kind) if kind == "exact" else None
    inside = sum(weight[t] for t in sequence[first : last + 1])
    matched = sum(weight[t] for t in terms)
    steps = [(q - p <= 4 and r - o <= 2) for (p, o), (q, r) in pairwise(chain)]
    counts = (
        span >= (_least(length) if len(chain) == span else SHARE * length)
        and len(chain) >= DENSITY * span
        and len(chain) >= 2
        and matched >= WEIGHT_DENSITY * inside - 1e-6
        and sum(steps) >= CLOSE_STEPS * len(steps)
    )
    return (first, last, terms, kind) if counts else None


def corpus_weights(index: DataFrame, passages: DataFrame, vocabulary: TestVocabulary, frequency: dict[int, int]) -> np.ndarray:
    """Weight of each term, the less the more documents have it outside the passages found."""
    n_documents = max(index.count(), 1)
    outside = np.array([frequency.get(t, 0) for t in range(len(vocabulary.terms))], dtype=float)
    counted = passages.select(F.explode("new_terms").alias("number")).groupBy("number").agg(F.count(F.lit(1)).alias("inside"))
    for row in counted.toLocalIterator():  # at most one row per distinct word of the block of items
        outside[row["number"]] -= row["inside"]
    return vocabulary.weight * (np.log1p(n_documents / (1 + outside)) / math.log1p(n_documents)) ** 2


def _has_facts(weight: np.ndarray, sequence: np.ndarray, first: int, last: int, terms: list[int], kind: str) -> bool:
    """Whether a passage holds the facts of its stretch of the item, not only stock phrases; an unbroken half needs none."""
    if kind != "proximity" and 2 * len(terms) >= len(sequence):
        return True
    matched = weight[terms].sum() + 1e-6
    return bool(matched >= FACT_DENSITY * weight[sequence[first : last + 1]].sum() and matched >= LEAST_FACTS * weight[sequence].sum())


def search_index(index: DataFrame, vocabulary: TestVocabulary) -> DataFrame:
    """(doc, item, span, matched, n_words, kind) of each passage of a block of items that counts."""
    kind = index.schema["doc"].dataType.simpleString()
    frequency = document_frequencies(index, vocabulary)
    chosen = [vocabulary.anchors(k, frequency) for k in range(len(vocabulary.sequences))]
    shared = index.sparkSession.sparkContext.broadcast((vocabulary, chosen))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, anchored = shared.value
        of_anchor: dict[int, list[int]] = defaultdict(list)
        for k, ts in enumerate(anchored):
            for t in ts:
                of_anchor[t].append(k)
        is_anchor = np.zeros(len(known.terms) + 1, dtype=bool)  # the last place is that of unknown words, code -1
        is_anchor[list(of_anchor)] = True
        value_set, weight = pa.array(known.terms, pa.string()), known.weight.tolist()
        sequences = [s.tolist() for s in known.sequences]
        present = np.zeros(len(known.terms))
        for batch in batches:
            ids, lengths = batch.column(0), pc.list_value_length(batch.column(1)).to_numpy(zero_copy_only=False)
            codes = pc.fill_null(pc.index_in(batch.column(1).flatten(), value_set=value_set), -1).to_numpy(zero_copy_only=False)
            counts = batch.column(2).flatten().to_numpy(zero_copy_only=False)
            places = batch.column(3).flatten().to_numpy(zero_copy_only=False)
            ends = np.cumsum(counts)
            rows = np.repeat(np.arange(batch.num_rows), lengths)
            from_row = np.concatenate(([0], np.cumsum(lengths)))
            out: list[list] = [[], [], [], [], [], [], []]
            for row in np.unique(rows[is_anchor[codes]]).tolist():
                at = np.arange(from_row[row], from_row[row + 1])
                at = at[codes[at] >= 0]
                here = codes[at]
                present[here] = 1.0
                where, told = None, set()  # told: terms that an earlier passage of the document has
                for k in sorted({k for t in here[is_anchor[here]].tolist() for k in of_anchor[t]}):
                    sequence = known.sequences[k]
                    filled = present[sequence]
                    if filled.sum() < known.least_words[k] - 1e-6 or not _can_fill(filled, known.weight[sequence]):
                        continue
                    if where is None:
                        where = {t: places[e - c : e].tolist() for t, c, e in zip(here.tolist(), counts[at].tolist(), ends[at].tolist(), strict=True)}
                    passage = _passage(where, sequences[k], anchored[k], weight)
                    if passage:
                        new = set(passage[2]) - told
                        told |= new
                        for values, value in zip(out, (ids[row].as_py(), k, *passage, sorted(new)), strict=True):
                            values.append(value)
                present[here] = 0.0
            kinds = (ids.type, pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.int32()), pa.string(), pa.list_(pa.int32()))
            names = ["doc", "sequence", "first", "last", "terms", "kind", "new_terms"]
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out, kinds, strict=True)], names)

    passages = stored(
        index.select("doc", "terms", "counts", "positions").mapInArrow(
            run, f"doc {kind}, sequence int, first int, last int, terms array<int>, kind string, new_terms array<int>"
        )
    )
    weighed = index.sparkSession.sparkContext.broadcast(corpus_weights(index, passages, vocabulary, frequency))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (known, _), weight = shared.value, weighed.value
        for batch in batches:
            out: list[list] = [[], [], [], [], [], []]
            for key, k, first, last, terms, how in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                sequence = known.sequences[k]
                for member in known.members[k] if _has_facts(weight, sequence, first, last, terms, how) else ():
                    for values, value in zip(out, (key, member, last - first + 1, len(terms), len(sequence), how), strict=True):
                        values.append(value)
            kinds = (batch.column(0).type, pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.string())
            names = ["doc", "item", "span", "matched", "n_words", "kind"]
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out, kinds, strict=True)], names)

    return passages.select("doc", "sequence", "first", "last", "terms", "kind").mapInArrow(
        judge, f"doc {kind}, item bigint, span int, matched int, n_words int, kind string"
    )


def find_leaks(
    documents: DataFrame, items: DataFrame, doc: str, text: str, item: str, item_text: str, index: DataFrame | None = None
) -> DataFrame:
    """(doc, item, span, matched, n_words, kind) of each document that carries at least half of an item in order.

    span: item words from the first to the last of the passage; matched: how many of them the document has; kind: exact if
    all of the item stands there word for word, phrase if a stretch long enough to count does, else proximity.  index: what
    build_index gave for these documents, if it is stored already; else it is stored in the shared folder.
    """
    kept = stored(build_index(documents, doc, text)) if index is None else index
    found = [search_index(kept, TestVocabulary(terms)) for terms in item_blocks(items, item, item_text)]
    if not found:
        found = [search_index(kept, TestVocabulary({}))]
    every = reduce(DataFrame.unionByName, found)
    return every.select(F.col("doc").alias(doc), F.col("item").alias(item), "span", "matched", "n_words", "kind")
