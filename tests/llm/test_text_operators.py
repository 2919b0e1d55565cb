"""Corpus encoding, leak search and reading level on small texts."""

from __future__ import annotations

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from starloom.llm import corpus_tokens as C
from starloom.llm import leak_search as L
from starloom.llm import reading_level as R
from starloom.llm.passages import best_passage
from starloom.llm.subtitles import fold, spoken_text, words
from tests.conftest import SMALL

FILE = f"{C.TOKENIZER_FOLDER}/{C.DEFAULT_FILE}"
ODD = [
    "", " ", "\n", "a \n", "   ", "  a \n\n b\r\n\r\nc  ", "x  y\t\tz\n", "12:3 5² 3²4 1,2.3 4:5:", "it's 'tis  's", "a​b \xa0c\xa0 d", "é́ 　x \x85 y",
    "<|endoftext|> hi <|endoftext|>", "\x1cabc \x1f d", "🎬🎬 字幕：x", "﻿1\r\n00:00:01,000 --> 00:00:02,500\r\nHi\r\n", "a" * 5000, "ab " * 4000,
]


def direct(text):
    return C._tokenizer(FILE).encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("text", ODD)
def test_pieces_encode_like_the_whole(text):
    assert C.encode_texts([text], C._tokenizer(FILE), {})[0] == direct(text)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" \n\r\t\xa0ab1,.:'-é²"), st.characters(exclude_categories=["Cs"])), max_size=60))
def test_any_text_encodes_like_the_whole(text):
    assert C.encode_texts([text], C._tokenizer(FILE), {})[0] == direct(text)


def test_encode_and_decode_tables(spark, monkeypatch):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(ODD)] + [(-1, None, "x"), (-1, "twice", "x")], "doc_id bigint, text string, ids string")
    ids = C.encode(df, "doc_id", "text")
    found = {r["doc_id"]: r["ids"] for r in ids.filter("doc_id >= 0").collect()}
    assert found == {i: direct(t) for i, t in enumerate(ODD)}
    assert sorted(r["ids"] for r in ids.filter("doc_id < 0").collect()) == [[], direct("twice")]
    back = {r["doc_id"]: r["text"] for r in C.decode(ids.filter("doc_id >= 0"), "doc_id", "ids").collect()}
    assert back == dict(enumerate(ODD))
    assert C.encode(df.limit(0), "doc_id", "text").count() == 0


def test_cut_lists_and_null_lists_decode(spark):
    ids = direct("字")
    assert len(ids) > 1
    df = spark.createDataFrame([(1, ids), (2, ids[:1]), (3, None), (4, [])], "k int, ids array<int>")
    assert {r["k"]: r["text"] for r in C.decode(df, "k", "ids").collect()} == {1: "字", 2: "�", 3: "", 4: ""}


def test_offsets_cover_the_text(spark):
    text = "Él comió 字 ya 🎬."
    row = C.encode_with_offsets(spark.createDataFrame([(1, text)], "k int, t string"), "k", "t").first()
    assert row["ids"] == direct(text)
    assert row["starts"][0] == 0 and row["ends"][-1] == len(text)
    covered = {c for a, b in zip(row["starts"], row["ends"], strict=True) for c in range(a, b)}
    assert covered == set(range(len(text)))


@pytest.mark.parametrize("size", [1, 3, len(ODD)])
def test_ranges_are_those_of_the_whole(monkeypatch, size):
    monkeypatch.setattr(C, "CACHED_PIECES", 20)
    loaded, cache = C._tokenizer(FILE), C.PieceRanges()
    for k in range(0, len(ODD), size):
        bounds, ids, starts, ends = C.encode_ranges(ODD[k : k + size], loaded, cache)
        for n, text in enumerate(ODD[k : k + size]):
            whole, part = loaded.encode(text, add_special_tokens=False), slice(bounds[n], bounds[n + 1])
            assert ids[part].tolist() == whole.ids and list(zip(starts[part].tolist(), ends[part].tolist(), strict=True)) == whole.offsets


def test_byte_table_is_a_bijection():
    assert sorted(C.byte_table().values()) == list(range(256))


def test_cache_starts_anew(monkeypatch):
    monkeypatch.setattr(C, "CACHED_PIECES", 3)
    cache = {}
    for text in ("one two three four", "five six", "one two"):
        assert C.encode_texts([text], C._tokenizer(FILE), cache)[0] == direct(text)


def subtitle(lines):
    return "\n\n".join(f"{n}\n00:00:{n % 60:02d},000 --> 00:00:{n % 60:02d},900\n{x}" for n, x in enumerate(lines, 1)) + "\n"


def test_spoken_words():
    text = "﻿" + subtitle(
        ["<i>Hi, BOB</i>", "[door creaks]", "ANNA: I see​ it.", "* sighs *", "♪ la la ♪", "Subtitles by Zed\nwww.x.example", "(╯°□°)", "{\\an8}El jardÃ\xadn WÃÂ¤hrend", "r0ck 1912 &aacute;"]
    )
    assert words(spoken_text(text)) == "hi bob i see it el jardin wahrend rock 1912 a".split()
    assert spoken_text(None) == "" and words(spoken_text(" \r\n ")) == []


NAMES = [f"{a}{b}{c}" for a in ("tor", "ve", "gla", "su", "mi") for b in ("la", "nou", "dre", "ki") for c in ("sk", "mar", "x", "ton")]
PLAIN = "the old man saw a red bus near our house and then my sister went back home again with it".split()


def make_items(rng, n=12):
    names = rng.sample(NAMES, len(NAMES))
    return {i: [w for k in range(8) for w in (rng.choice(PLAIN), rng.choice(PLAIN), names[(i * 6 + k) % len(names)])] for i in range(n)}


def test_leaks_against_planted_cases(spark):
    rng = random.Random(8)
    items = make_items(rng)
    filler = lambda n: [rng.choice(PLAIN) for _ in range(n)]
    docs, planted = [], set()

    def add(parts):
        lines = [" ".join(parts[k : k + 6]) for k in range(0, len(parts), 6)]
        docs.append((len(docs), subtitle(lines), "x", 1))
        return len(docs) - 1

    for i, ws in items.items():
        n = len(ws)
        planted.add((add(filler(40) + ws + filler(40)), i))
        start = rng.randrange(n - n * 2 // 3)
        planted.add((add(filler(40) + ws[start : start + n * 2 // 3] + filler(40)), i))
        planted.add((add(filler(30) + [x for w in ws for x in ([w, "um"] if rng.random() < 0.15 else [w.upper()])] + filler(30)), i))
        add(filler(60) + ws[: n // 4] + filler(60))
        add(filler(40) + rng.sample(ws, n) + filler(40))
        add(filler(120))
    twin = [(90, docs[0][1], "x", 1)]
    planted.add((90, 0))
    frame = spark.createDataFrame([*docs, *twin, (91, None, "x", 1), (92, "", "x", 1), (93, "word " * 30000, "x", 1)], "doc_id bigint, text string, item_id string, span int")
    tests = spark.createDataFrame([(i, " ".join(ws), "t") for i, ws in items.items()] + [(77, None, "t"), (78, "", "t")], "item_id bigint, text string, bench string")
    found = L.find_leaks(frame, tests, "doc_id", "text", "item_id", "text").collect()
    assert {(r["doc_id"], r["item_id"]) for r in found} == planted
    kinds = {(r["doc_id"], r["item_id"]): r["kind"] for r in found}
    assert kinds[0, 0] == "exact" and kinds[1, 0] == "phrase" and kinds[90, 0] == "exact"
    assert L.find_leaks(frame.limit(0), tests, "doc_id", "text", "item_id", "text").count() == 0
    assert L.find_leaks(frame, tests.limit(0), "doc_id", "text", "item_id", "text").count() == 0


def leak_pairs(spark, docs, items):
    frame = spark.createDataFrame(list(enumerate(docs)), "doc_id bigint, text string")
    tests = spark.createDataFrame(list(items.items()), "item_id bigint, text string")
    return {(r["doc_id"], r["item_id"]) for r in L.find_leaks(frame, tests, "doc_id", "text", "item_id", "text").collect()}


@pytest.mark.parametrize("half", [0, 1])
def test_a_half_copied_very_often_is_found(spark, half):
    names = [f"{a}{b}" for a in ("bra", "klo", "mu", "zi", "fre", "tas") for b in ("don", "vik", "lem", "sur", "pag")]
    docs = [" ".join(names[15 * half :][:15])] * 40
    assert leak_pairs(spark, docs, {1: " ".join(names), 2: "quite another text about nothing at all"}) == {(d, 1) for d in range(40)}


def test_halves_with_few_names_are_found(spark):
    rows = spark.read.parquet(f"{SMALL}/eval_items.parquet").select("item_id", "text").collect()
    items = {r["item_id"]: r["text"] for r in rows}
    docs, planted = [], set()
    for i in (42, 58, 211, 230):
        ws = words(fold(items[i]))
        half = (len(ws) + 1) // 2
        for start in range(len(ws) - half + 1):
            window = ws[start : start + half]
            others = {w for j, text in items.items() if j != i for w in words(fold(text))}
            names = [k for k, w in enumerate(window) if w not in others]
            for k in [None, *names]:
                planted.add((len(docs), i))
                docs.append(" ".join("xq" + w[::-1] if n == k else w for n, w in enumerate(window)))
    assert leak_pairs(spark, docs, items) == planted


def test_items_that_share_all_their_words_are_found(spark):
    ws = [a + b for a in ("bra", "klo", "mu", "zi") for b in ("don", "vik", "lem", "sur", "pag")]
    items = {1: " ".join(ws), 2: " ".join(ws[::-1]), 3: " ".join(ws[7 * k % 20] for k in range(20))}
    assert leak_pairs(spark, [items[1], items[2], items[3]], items) == {(0, 1), (1, 2), (2, 3)}


def test_stock_phrases_with_other_facts_are_no_leak(spark):
    rng = random.Random(5)
    stock = ["the constitutional jurisdiction of the assembly", "a statistically significant discrepancy", "presupposed the documentary authentication",
             "the gravitational perturbation", "an unprecedented irregularity", "ostensibly acknowledged the commission"]
    item = f"{stock[0]} left Kaimal near Stitosk {stock[1]} of Nitairn {stock[2]} from Rilath Brouhea answered Labros Vetoun near Gofip Sarmel and Tuvax Hilern"
    items = {1: item} | {k: f"the answer of {a} was given near {b} and {c} left from the isle of {d}" for k, (a, b, c, d) in enumerate(zip(*[iter(NAMES[:40])] * 4, strict=True), 2)}
    like = [" ".join([*rng.sample(stock[3:], 2), *stock[:3], *rng.sample(stock[3:], 2)]) for _ in range(10)]
    plain = [" ".join(rng.sample(stock, 4)[::-1]) for _ in range(300)]
    plain = [d for d in plain if not (d.find(stock[0]) < d.find(stock[1]) or d.find(stock[1]) < d.find(stock[2]))]
    leaks = [item, item.replace("Kaimal", "Kaymal").replace("Nitairn", "Nit airn")]
    assert leak_pairs(spark, leaks + like + plain, items) == {(0, 1), (1, 1)}
    assert leak_pairs(spark, leaks * 40 + like + plain, items) == {(d, 1) for d in range(80)}


def test_stock_phrases_without_facts_are_a_leak_only_as_an_unbroken_half(spark):
    left, right = "the constitutional jurisdiction of the assembly", "the methodological framework of the inquiry"
    items = {1: f"Kaimal of Stitosk Brouhea believed that {left} {right} left Nitairn for Rilath near Vetoun 7899 Gofip"}
    items |= {k: " ".join(NAMES[20 * k : 20 * k + 12]) for k in (2, 3)}
    docs = [f"that {left} {right}", items[1], *[f"{left} whereas {right}"] * 10, *[f"{right} ostensibly acknowledged {left}"] * 200]
    assert leak_pairs(spark, docs, items) == {(0, 1), (1, 1)}


def test_repeated_items_are_found_under_each_id(spark):
    ws = [a + b for a in ("bra", "klo", "mu", "zi") for b in ("don", "vik", "lem", "sur", "pag")]
    items = {1: " ".join(ws), 2: " ".join(ws).upper(), 3: " ".join(ws) + ".", 4: "nothing of the kind stands anywhere in here", 5: None}
    assert leak_pairs(spark, ["they said " + items[1], "quite different"], items) == {(0, 1), (0, 2), (0, 3)}


def test_items_from_one_template_are_found(spark):
    stem = "the old town of {0} has a bridge over the river {1} that was built in the year {2} by the master".split()
    names = [("Brado", "Vikla", "1411"), ("Suren", "Pagmu", "1502"), ("Lemzi", "Dontas", "1633"), ("Frevik", "Klodon", "1720")]
    items = {n: " ".join(stem).format(*x) for n, x in enumerate(names)}
    found = leak_pairs(spark, [f"well {items[n]} indeed" for n in range(4)], items)
    assert {(n, n) for n in range(4)} <= found


def test_short_items_count_whole_and_word_for_word(spark):
    items = {1: "Brado", 2: "red bus", 3: "seven blue lamps burn", 4: "seven blue lamps burn here"}
    docs = ["a brado", "the bus is red", "a red bus", "seven lamps burn blue", "now seven blue lamps burn", "seven blue old lamps burn"]
    found = leak_pairs(spark, docs, {k: v for k, v in items.items() if k < 4})
    assert found == {(0, 1), (2, 2), (4, 3)}


def test_items_in_other_scripts_are_found(spark):
    items = {
        1: "Старый мост через реку построил мастер Бродин в тысяча четыреста одиннадцатом году",
        2: "这座古老的桥梁是由布罗丁大师在一四一一年建造的并且至今仍然完好",
        3: "Η παλιά γέφυρα χτίστηκε από τον μάστορα Μπροντίν πριν από πολλά χρόνια",
    }
    plain = "\n".join(["the old man saw a red bus near our house"] * 30)
    docs = [f"1\n00:00:01,000 --> 00:00:02,000\n{t}\n" for t in items.values()] + [f"{plain}\n{t}\n{plain}" for t in items.values()]
    assert leak_pairs(spark, docs, items) == {(d, d % 3 + 1) for d in range(6)}


def test_kind_asks_for_neighbouring_positions(spark):
    ws = [a + b for a in ("bra", "klo", "mu", "zi") for b in ("don", "vik", "lem", "sur", "pag")]
    filled = [x for k, w in enumerate(ws) for x in ([w, "um", "er"] if k % 3 == 2 else [w])]
    docs = [" ".join(ws), " ".join(filled), " ".join(ws[3:17]), " ".join(filled[:18])]
    frame = spark.createDataFrame(list(enumerate(docs)), "doc_id bigint, text string")
    tests = spark.createDataFrame([(1, " ".join(ws))], "item_id bigint, text string")
    found = {r["doc_id"]: r["kind"] for r in L.find_leaks(frame, tests, "doc_id", "text", "item_id", "text").collect()}
    assert found == {0: "exact", 1: "proximity", 2: "phrase", 3: "proximity"}


def test_large_test_sets_are_searched_in_blocks_over_one_index(spark, monkeypatch):
    rng = random.Random(3)
    items = {i: " ".join(ws) for i, ws in make_items(rng).items()}
    docs = [*items.values(), "the old man saw a red bus", None, ""]
    whole = leak_pairs(spark, docs, items)
    assert {(i, i) for i in items} <= whole
    monkeypatch.setattr(L, "BLOCK_WORDS", 50)
    assert len(list(L.item_blocks(spark.createDataFrame(list(items.items()), "i bigint, t string"), "i", "t"))) > 2
    assert {(i, i) for i in items} <= leak_pairs(spark, docs, items)
    frame = spark.createDataFrame(list(enumerate(docs)), "doc_id bigint, text string")
    index = L.build_index(frame, "doc_id", "text").cache()
    for chosen in ([0, 1], [5]):
        tests = spark.createDataFrame([(i, items[i]) for i in chosen], "item_id bigint, text string")
        again = L.find_leaks(frame, tests, "doc_id", "text", "item_id", "text", index)
        assert {(r["doc_id"], r["item_id"]) for r in again.collect()} == {(i, i) for i in chosen}


def test_index_holds_every_word_with_its_positions(spark):
    frame = spark.createDataFrame([(1, "Up and up, and away"), (2, None), (3, " ")], "doc_id bigint, text string")
    row = L.build_index(frame, "doc_id", "text").collect()
    assert [(r["doc"], r["terms"], r["counts"], r["positions"]) for r in row] == [(1, ["up", "and", "away"], [2, 2, 1], [0, 2, 1, 3, 4])]


def test_best_passage():
    in_order = [(10 + k, k) for k in range(8)]
    assert best_passage(in_order, {2, 5})[:2] == (0, 7)
    shuffled = [(p, o) for p, o in zip(range(10, 18), [5, 1, 7, 3, 0, 6, 2, 4], strict=True)]
    assert len(best_passage(shuffled, set())[2]) < 5
    assert best_passage([], set()) == (0, -1, [])


@pytest.fixture(scope="module")
def samples(spark):
    return spark.read.parquet(f"{SMALL}/level_samples.parquet")


def test_held_out_levels(samples):
    rows = [tuple(r) for r in samples.select("lang", "level", "text").orderBy("sample_id").collect()]
    hits = 0
    for fold_number in range(6):
        model = R.fit([r for k, r in enumerate(rows) if k % 6 != fold_number])
        for language, level, text in rows[fold_number::6]:
            folded = fold(text)
            hits += model[language].level(model[language].score(folded, words(folded))) == level
    assert hits / len(rows) >= 0.95


def test_reading_levels_table(spark, samples):
    texts = {(r["lang"], r["level"]): r["text"] for r in samples.collect()}
    docs = [(n, subtitle([" ".join(t.split()[k : k + 7]) for k in range(0, len(t.split()), 7)]), "zz", 0) for n, t in enumerate(texts.values())]
    docs += [(100, None, "en", 0), (101, "", "en", 0), (102, "short text", "en", 0), (103, subtitle(["www.x.example"] * 90), "en", 0), (104, docs[0][1], "en", 0)]
    frame = spark.createDataFrame(docs, "doc_id bigint, text string, lang string, level int")
    found = {r["doc_id"]: (r["language"], r["level"]) for r in R.reading_levels(frame, samples).collect()}
    assert found == {n: k for n, k in enumerate(texts)} | {104: next(iter(texts))}
    assert R.reading_levels(frame.limit(0), samples).count() == 0
    assert R.reading_levels(frame, samples.limit(0)).count() == 0


def test_a_language_without_samples_has_no_level(spark, samples):
    finnish = "vanha silta joen yli rakennettiin kolmesataa vuotta sitten ja se kestää yhä hyvin kaupungin laidalla " * 6
    frame = spark.createDataFrame([(1, finnish), (2, "Старый мост через реку построил мастер в старом городе " * 10)], "doc_id bigint, text string")
    found = R.reading_levels(frame, samples).collect()
    assert sorted((r["doc_id"], r["language"], r["score"], r["level"]) for r in found) == [(1, None, None, None), (2, None, None, None)]


def test_drawn_pairs_rank_like_all_pairs(monkeypatch):
    rng = np.random.default_rng(4)
    level = rng.integers(1, 5, 400).astype(float)
    x = np.column_stack([level + rng.normal(size=400), rng.normal(size=400)])
    whole = R.rank_weights(x, level)
    monkeypatch.setattr(R, "LEVEL_PAIRS", 500)
    assert len(R.rank_pairs(level)[0]) == 6 * 500
    drawn = R.rank_weights(x, level)
    assert np.abs(drawn - whole).max() < 0.3 and drawn[0] > 5 * abs(drawn[1])
    higher, lower = R.rank_pairs(np.array([2.0, 1.0, 1.0]))
    assert list(zip(higher.tolist(), lower.tolist(), strict=True)) == [(0, 1), (0, 2)]


def test_isotonic_is_monotone():
    rng = np.random.default_rng(1)
    score = rng.normal(size=200)
    knots, values = R.isotonic(score, np.round(score + rng.normal(size=200)))
    assert (np.diff(values) >= 0).all() and (np.diff(knots) >= 0).all()
