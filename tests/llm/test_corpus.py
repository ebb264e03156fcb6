import collections
import pickle
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from decidra.llm import language, leakage, overlap, packing


def brute(rows):
    bags = {i: collections.Counter(overlap.words(t)) for i, _, t in rows}
    out = set()
    for i, h, _ in rows:
        for j, g, _ in rows:
            if h is False and g is True:
                n = max(sum(bags[i].values()), sum(bags[j].values()))
                if n and sum((bags[i] & bags[j]).values()) * 10 >= 8 * n:
                    out.add((i, j))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_overlaps_like_brute_force(spark, seed):
    rng = random.Random(seed)
    common = [f"w{i}" for i in range(60)]
    rows, base = [], []
    for i in range(240):
        if base and rng.random() < 0.5:
            words = list(rng.choice(base))
            for _ in range(int(len(words) * rng.choice([0, 0.1, 0.2, 0.3]))):
                k = rng.randrange(len(words))
                words[k : k + rng.randrange(2)] = [f"n{rng.randrange(10**6)}"] if rng.random() < 0.8 else []
            rng.shuffle(words) if rng.random() < 0.3 else None
        else:
            words = [rng.choice(common) if rng.random() < 0.75 else f"n{rng.randrange(400)}" for _ in range(rng.choice([1, 3, 10, 30, 75]))]
        base.append(words)
        text = " ".join(words)
        rows.append((i, rng.choice([True, False, False, None]), rng.choice([text, text.upper() + "!", f"<p>{text}&nbsp;</p>"])))
    rows += [(1000, True, None), (1001, False, ""), (1002, True, "?!"), rows[0]]
    df = spark.createDataFrame(rows, "row_id long, held boolean, state string").repartition(3)
    got = [(r.train_id, r.held_out_id) for r in overlap.cross_split_overlaps(df, "row_id", "state", F.col("held")).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows)


def test_overlaps_of_empty_tables(spark):
    df = spark.createDataFrame([], "row_id long, held boolean, state string")
    assert overlap.cross_split_overlaps(df, "row_id", "state", F.col("held")).count() == 0


def test_banded_alignment():
    assert overlap.overlap(list("abcde"), list("abcdf")) == 4 and overlap.overlap(list("abcde"), list("abcxy")) == 0
    assert overlap.words("It&#39;s <b>A</b>\\n test_1") == ["it", "s", "a", "test", "1"]


ITEM = "alpha bravo charlie delta echo foxtrot golf hotel india juliet kilo lima mike november oscar papa quebec romeo sierra tango"


def leak(spark, texts, items=((1, ITEM, "en"),)):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    table = spark.createDataFrame(list(items), "item_id long, text string, lang string")
    return {(r.doc_id, r.item_id): r.repeated for r in leakage.leaks(docs, "doc_id", "text", table, "item_id", "text", "lang").collect()}


def test_leaks(spark):
    w = ITEM.split()
    noisy = " ".join("xx" if k == 9 else x for k, x in enumerate(w))
    texts = ["start " + ITEM.upper().replace(" ", ", ") + " end", " ".join(w[:10]) + " stop", " ".join(w[:9]) + " stop", noisy, " ".join(x if k % 4 else "zz" for k, x in enumerate(w)), None, "", " ".join(w[:5]) + " q r s t " + " ".join(w[10:15])]
    assert leak(spark, texts) == {(0, 1): 20, (1, 1): 10, (3, 1): 19}


def repeated(doc, item, least):
    """The units of the item in passages, by a plain table: per cell and number of columns the best sum of +1 and -7."""

    def table(a, b):
        ends, cells = {}, {}
        for i in range(len(a)):
            for j in range(len(b)):
                new = collections.defaultdict(lambda: -(10**9))
                if a[i] == b[j]:
                    new[1] = 1
                for n, v in cells.get((i - 1, j - 1), {}).items():
                    new[min(n + 1, least)] = max(new[min(n + 1, least)], v + (1 if a[i] == b[j] else -7))
                ends[i, j] = dict(new) if a[i] == b[j] else {}
                for k in ((i - 1, j), (i, j - 1)):
                    for n, v in cells.get(k, {}).items():
                        new[min(n + 1, least)] = max(new[min(n + 1, least)], v - 7)
                cells[i, j] = dict(new)
        return ends

    left, right = table(item, doc), table(item[::-1], doc[::-1])
    found = set()
    for (i, j), sums in left.items():
        back = right[len(item) - 1 - i, len(doc) - 1 - j]
        if any(n + m > least and v + w > 0 for n, v in sums.items() for m, w in back.items()):
            found.add(i)
    return len(found)


def test_leaks_with_changes_near_the_ends_like_brute_force(spark):
    w = ITEM.split()
    assert leak(spark, [" ".join([*w[:5], "xx", *w[6:10]])], [(1, " ".join(w[:18]), "en")]) == {(0, 1): 9}
    texts = []
    for at in range(2, 7):
        for kind in ([], ["xx"], ["xx", "yy"]):
            texts += [" ".join(["q", *part[:k], *kind, *part[k + (len(kind) < 2) :], "z"]) for part in (w[:11], w[8:], w[4:15]) for k in (at - 1, len(part) - at)]
    want = {(i, 1): n for i, t in enumerate(texts) if 2 * (n := repeated(t.split(), w, leakage.LEAST)) >= len(w)}
    assert want and leak(spark, texts) == want


def marked(flags, words):
    return " ".join(f"x{k}" if f else w for k, (f, w) in enumerate(zip(flags, words)))


def test_leaks_in_overlapping_and_repeated_passages(spark):
    words = [f"w{k}" for k in range(60)]
    both = [0] * 12 + [1] + [0] * 5 + [1] * 9 + [0] * 5 + [1] + [0] * 12
    assert leak(spark, [marked(both, words)], [(1, " ".join(words), "en")]) == {(0, 1): 34}
    shared = [0] * 4 + [1] + [0] * 5 + [1] + [0] * 4  # two passages of ten with one run of five in common
    assert leak(spark, [marked(shared, words)], [(1, " ".join(words[:26]), "en")]) == {(0, 1): 13}
    phrase = [f"p{k}" for k in range(6)]
    item = [*words[:6], *phrase, *words[6:12], *phrase, *words[12:18]]
    texts = [" ".join([*words[:6], *phrase, "and", *phrase, *words[12:18]]), " ".join([*phrase, *words[6:12], "b", *phrase, "b", *words[:6], *phrase])]
    want = {(i, 1): n for i, t in enumerate(texts) if 2 * (n := repeated(t.split(), item, leakage.LEAST)) >= len(item)}
    assert len(want) == 2 and leak(spark, texts, [(1, " ".join(item), "en")]) == want


@pytest.mark.parametrize("seed", range(4))
def test_leaks_of_random_edits_like_brute_force(spark, seed):
    rng = random.Random(seed)
    words = [f"w{rng.randrange(14)}" for _ in range(44)]  # few words, so that many diagonals meet
    texts = []
    for _ in range(14):
        a = rng.randrange(0, 20)
        part = words[a : a + rng.randrange(18, 44)]
        for _ in range(rng.randrange(0, 5)):
            k = rng.randrange(len(part))
            part = rng.choice([part[:k] + part[k + 1 :], [*part[:k], "x", *part[k:]], [*part[:k], "y", *part[k + 1 :]], [*part[:k], *part[max(0, k - 7) : k], *part[k:]]])
        texts.append(" ".join(["q", *part, "z"]))
    want = {(i, 1): n for i, t in enumerate(texts) if 2 * (n := repeated(t.split(), words, leakage.LEAST)) >= len(words)}
    assert leak(spark, texts, [(1, " ".join(words), "en")]) == want
    docs, table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), spark.createDataFrame([(1, " ".join(words), "en")], "item_id long, text string, lang string")
    found = leakage.leaks(docs, "doc_id", "text", table, "item_id", "text", "lang", count=False).collect()
    assert {(r.doc_id, r.item_id) for r in found} == set(want)


def test_leaks_by_characters(spark):
    item = "这是一个用来检查泄漏的句子它必须足够长才能被识别出来谢谢大家的帮助"
    got = leak(spark, ["前面" + item[:22] + "后面", item[:15], item.replace("句", "词")], ((7, item, "zh"), (8, None, "zh"), (9, "短", "zh")))
    assert (0, 7) in got and (1, 7) not in got and got[2, 7] == len(item) - 1


def test_leaks_with_words_of_one_checksum(spark):
    words = ["plumless" if k == 9 else w for k, w in enumerate(ITEM.split())]  # buckeroo has its length and CRC-32
    assert leak(spark, [" ".join("buckeroo" if w == "plumless" else w for w in words)], [(1, " ".join(words), "en")]) == {(0, 1): 19}


def test_leaks_of_batches_larger_than_a_slice(spark):
    n = 2 * leakage.DOCS_AT_ONCE + 1
    docs = spark.createDataFrame([(i, ITEM if i % 500 == 0 else f"none {i}") for i in range(n)], "doc_id long, text string").coalesce(1)
    table = spark.createDataFrame([(1, ITEM, "en")], "item_id long, text string, lang string")
    assert {r.doc_id for r in leakage.leaks(docs, "doc_id", "text", table, "item_id", "text", "lang").collect()} == set(range(0, n, 500))


def test_items_are_sent_without_what_their_hashes_tell():
    words = ITEM.split()
    index = leakage.Items(False, [1, 2], [words, words[::-1]])
    sent = pickle.dumps(index)
    assert len(sent) < 10_000  # 16 MB would lie on the disk of every executor
    again, codes = pickle.loads(sent), leakage._codes([*words, "q", *words[::-1], "r"], index.numbers)
    hashes = leakage.shingles(codes, leakage.RUN)
    assert index.known(hashes).sum() == 32 and (again.known(hashes) == index.known(hashes)).all()


def test_least_hits_is_a_bound():
    rng = random.Random(1)
    for n in (20, 37, 60, 76):
        low = leakage.least_hits(n, leakage.RUN, leakage.LEAST)
        for _ in range(200):  # half the item in passages of ten words with the worst deviation
            size = rng.randrange(leakage.LEAST, 30)
            hits = size - 4 - 5 * (size // 8)
            count = -(-((n + 1) // 2) // size)
            assert count * max(1, hits) >= low


@pytest.mark.parametrize("seed", range(3))
def test_packing(spark, seed):
    rng = random.Random(seed)
    rows = [(i, rng.choice(["é", "x"]) * rng.choice([0, 1, 3, 17, 40, 99, 100, 101, 250])) for i in range(400)] + [(1000, None), (0, None)]
    out = packing.pack(spark.createDataFrame(rows, "id long, t string"), "id", "t", 100).collect()
    load, tokens = collections.Counter(), collections.Counter()
    for r in out:
        load[r.container] += r.n_tokens
        tokens[r.id] += r.n_tokens
    assert tokens == {i: len(t.encode()) + 1 for i, t in rows if t is not None} and max(load.values()) <= 100 and set(load) == set(range(len(load)))
    assert all(r.piece_no == 1 for r in out if tokens[r.id] <= 100) and len(load) <= -(-sum(load.values()) // 100) * 1.1 + 1
    for i in tokens:
        own = sorted((r.start_token, r.n_tokens) for r in out if r.id == i)
        assert [s for s, _ in own] == [sum(n for _, n in own[:k]) for k in range(len(own))]


def test_packing_edges(spark):
    empty = spark.createDataFrame([], "id long, t string")
    assert packing.pack(empty, "id", "t").count() == 0
    with pytest.raises(ValueError):
        packing.pack(empty, "id", "t", 0)
    counts = {60: 3, 40: 3, 7: 1}
    matches, n = packing.best_fit(counts, 100)
    assert n == 4 and sum(m[3] for m in matches) == 7


TEXTS = {
    "en": "The clerk returns the parcel in the morning. Nobody at the counter had expected this today.",
    "de": "Die Nachtschicht bringt das Paket am Morgen zurück. Niemand am Schalter hatte das heute erwartet.",
    "fr": "Le guichet rend le colis dans la matinée. Personne au comptoir ne s’y attendait vraiment.",
    "ru": "Служба доставки вернула посылку утром. Никто в отделе этого сегодня не ждал.",
}


def test_language_segments(spark):
    rows = [(i, lang, text) for i, (lang, text) in enumerate(list(TEXTS.items()) * 12)]
    rows += [(900, "German", TEXTS["fr"]), (901, None, TEXTS["ru"]), (902, "en", TEXTS["en"] + " " + TEXTS["ru"]), (903, "eng", None), (904, "xx", ""), (905, "en-US", TEXTS["en"])]
    df = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    got = collections.defaultdict(list)
    for r in language.segments(df, "doc_id", "text", "lang").orderBy("doc_id", "seg_no").collect():
        got[r.doc_id].append((r.lang, r.n_segments))
        assert 0 <= r.confidence <= 1
    assert got[900] == [("fr", 1)] and got[901] == [("ru", 1)] and got[902] == [("en", 2), ("ru", 2)] and got[905] == [("en", 1)] and 903 not in got and 904 not in got
    assert language.segments(df.where("doc_id = 904"), "doc_id", "text", "lang").count() == 0


def test_codewords_and_labels():
    w = language.codewords(15)
    assert all(np.sum(a != b) * 2 >= w.shape[1] for i, a in enumerate(w) for b in w[:i])
    assert [language.code_of(x) for x in ("English", "eng", "en_GB", "zh_Hans", "UK", "xx", "", None, "da")] == ["en", "en", "en", "zh", "uk", None, None, None, None]
