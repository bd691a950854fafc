"""Operators over text corpora against brute force on small tables, with the cases each docstring defines."""

import math
import random
import re
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from linkloom.llm import code_language, distinctive, encode, leaks, near_copies, ngrams, repetition, splits
from linkloom.llm.words import words

ODD = [None, "", "   \n", "?!", "word", "É" + "é" * 3 + " x\u200by\u00adz \ufeffQ", "a " * 5000]


def docs(spark, texts, key="doc_id", col="text", extra=True):
    df = spark.createDataFrame(list(enumerate(texts)), f"{key} long, {col} string")
    # names that the operators use inside
    return df.select("*", *(F.lit(1).alias(c) for c in ("_id", "_text", "term", "n", "size", "rule", "hi", "lo", "windows"))) if extra else df


def phrase(rng, n, vocab=400):
    return " ".join(f"w{rng.randrange(vocab)}" for _ in range(n))


def test_words():
    assert words("Éa1 b_c X\u00adY e\u0301") == ["éa1", "b", "c", "xy", "é"]
    assert words(None) == words("") == words(" -- ") == []


# --- 1 ---------------------------------------------------------------------------------------------------------

def test_once_keeps_the_first_row_of_a_key_and_every_row_without_one():
    from linkloom.llm.words import once

    b = [pa.RecordBatch.from_arrays([pa.array(k, pa.int64()), pa.array(v)], names=["_id", "v"]) for k, v in (([None, None, 1, 1], [0, 1, 2, 3]), ([1, 2], [4, 5]), ([], pa.array([], pa.int64())), ([2, 3], [6, 7]))]
    assert [x for r in once(iter(b)) for x in r.column("v").to_pylist()] == [0, 1, 2, 5, 7]


JAVA = '''// if (x == 3) return y;
/** The system asks the nurse to print the form
 *  before the daily closing starts. @see #x {@code y} */
class DBRefreshmentPoint {
  String query = "UPDATE t SET d = '" + "Il sistema deve poter "
      + "stampare l''archivio della scheda." + "' WHERE id = " + id;
  String u = "https://a.b/c", k = "a.b.c", f = "%s;%d";
  char c = '"';
  private String[] headers = { "Fecha de nacimiento", "N\\u00famero de tel\\u00e9fono", "Estado" };
}'''
TRAIN = {
    "en": "The system asks the nurse to print the form before the daily closing starts and the guest has to wait until the office answers. ",
    "it": "Il sistema deve poter stampare la scheda prima della chiusura e il visitatore deve attendere la risposta dell'ufficio anagrafe. ",
    "es": "El sistema debe poder imprimir la fecha de nacimiento y el número de teléfono del huésped según el estado de la solicitud. ",
    "de": "Das System soll das Formular vor dem Tagesabschluss drucken können und der Gast muss auf die Antwort des Amtes warten. ",
    "fr": "Le système doit pouvoir imprimer le formulaire avant la clôture et le visiteur doit attendre la réponse du bureau. ",
}


def _labelled(spark):
    return spark.createDataFrame([(i, k.upper() if i % 2 else k, v * 4) for i, (k, v) in enumerate(TRAIN.items())], "doc_id long, lang string, text string")


def _files(spark, contents):
    return spark.createDataFrame([(i, "A.java", c, 1) for i, c in enumerate(contents)], "file_id long, file_name string, content string, loaded_at int")


def test_code_spans():
    got = list(code_language.spans(JAVA, python=False))
    assert "The system asks the nurse to print the form before the daily closing starts." in got
    assert "Il sistema deve poter stampare l'archivio della scheda." in got
    assert "Fecha de nacimiento Número de teléfono Estado" in got and len(got) == 3
    py = 'def f():\n    # a comment that is written in words\n    """Doc string of some words here."""\n    x = \'key.of.thing\'\n'
    assert list(code_language.spans(py, python=True)) == ["a comment that is written in words", "Doc string of some words here."]
    assert list(code_language.spans("/* never closed but still written", python=False)) == ["never closed but still written"]


def test_code_language(spark):
    files = _files(spark, [JAVA, JAVA, None, "", "int x;", "// Das System soll das Formular drucken können\n" * 400])
    files = files.unionByName(files.withColumn("loaded_at", F.lit(2)))
    rows = code_language.language_shares(files, _labelled(spark)).collect()
    by = {(r.file_id, r.lang): r for r in rows}
    assert {k for k in by if k[0] in (0, 1)} == {(i, x) for i in (0, 1) for x in ("en", "it", "es")} and (5, "de") in by
    assert by[0, "en"].chars == len("The system asks the nurse to print the form before the daily closing starts.") and by[0, "en"].length == len(JAVA)
    assert {k[0] for k in by} == {0, 1, 5}
    assert code_language.language_shares(files.limit(0), _labelled(spark)).count() == 0
    assert code_language.language_shares(files, _labelled(spark).limit(0)).count() == 0


# --- 2, 3 ------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("size", [1, 3])
def test_term_frequencies(spark, size):
    rng = random.Random(1)
    texts = [phrase(rng, rng.randrange(30), 15) for _ in range(60)] + ODD
    df = docs(spark, texts, "req_id", "req_text")
    df = df.unionByName(df.limit(20)).unionByName(spark.createDataFrame([(None, "lone term"), (None, "lone term")], "req_id long, req_text string").join(df.drop("req_id", "req_text").limit(1)))
    recs = [words(t) for t in texts] + [["lone", "term"]] * 2
    recs = [r for r in recs if r]
    tf, dfq = Counter(), Counter()
    for r in recs:
        g = [" ".join(r[i : i + k]) for k in range(1, size + 1) for i in range(len(r) - k + 1)]
        tf.update(g)
        dfq.update(set(g))
    got = {r.term: r for r in ngrams.term_frequencies(df, size, "req_id", "req_text").collect()}
    assert {t: (r.occurrences, r.records) for t, r in got.items()} == {t: (tf[t], dfq[t]) for t in tf}
    for t, r in got.items():
        assert r.total == len(recs) and r.mark == ("rare" if dfq[t] <= 2 or tf[t] <= 3 else "common" if dfq[t] > 0.1 * len(recs) else None)
    assert ngrams.term_frequencies(df.limit(0), size).count() == 0


def test_distinctive_terms(spark):
    rng = random.Random(2)
    texts = [phrase(rng, rng.randrange(40), 60) for _ in range(80)] + ODD
    df = docs(spark, texts, "req_id", "req_text")
    recs = {i: Counter(words(t)) for i, t in enumerate(texts) if words(t)}
    n, dfq = len(recs), Counter(t for r in recs.values() for t in r)
    got = distinctive.distinctive_terms(df.unionByName(df)).collect()
    assert len(got) == sum(map(len, recs.values()))
    for r in got:
        raw = {t: c * math.log((1 + n) / (1 + dfq[t])) for t, c in recs[r.req_id].items()}
        norm = math.sqrt(sum(x * x for x in raw.values()))
        assert r["count"] == recs[r.req_id][r.term] and r.records == dfq[r.term] and r.weight == pytest.approx(raw[r.term] / norm if norm else 0.0) and 0 <= r.elite <= 1
    assert distinctive.distinctive_terms(df.limit(0)).count() == 0


def test_two_poisson_finds_the_rates():
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.poisson(0.1, 9000), rng.poisson(5, 1000)])
    k, c = np.unique(x[x > 0], return_counts=True)
    low, high, share = (float(v[0]) for v in distinctive.fit_two_poisson(k[None].astype(float), c[None].astype(float), len(x), 200))
    assert low == pytest.approx(0.1, abs=0.03) and high == pytest.approx(5, abs=0.3) and share == pytest.approx(0.1, abs=0.02)


# --- 4 ---------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("block", [near_copies.HOT_CLASSES, 3])
def test_near_copies(spark, block):
    """Also where elements of a few classes are cut into blocks."""
    rng = random.Random(3)
    texts = list(ODD)
    for _ in range(40):
        base = phrase(rng, rng.randrange(15, 60)).split()
        texts.append(" ".join(base))
        for _ in range(rng.randrange(4)):
            edit = list(base)
            for _ in range(rng.randrange(6)):
                edit[rng.randrange(len(edit))] = f"w{rng.randrange(400)}"
            texts.append(" ".join(edit))
    hot = phrase(rng, 30)
    first_hot = len(texts)
    texts += [hot] * 90
    df = docs(spark, texts, "method_id", "body")
    sets = {i: frozenset(zip(w, w[1:], w[2:])) for i, t in enumerate(texts) if len(w := words(t)) >= 20}
    true = {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) * 2 >= len(sets[a] | sets[b])}
    got = near_copies.near_copy_pairs(df.unionByName(df), hot_classes=block).collect()
    pairs = {(r.id_a, r.id_b) for r in got}
    assert len(got) == len(pairs) and pairs <= true
    # the ninety copies are stated by their smallest id, everything else in full
    hot_ids = set(range(first_hot, len(texts)))
    assert {p for p in true if not hot_ids & set(p)} == {p for p in pairs if not hot_ids & set(p)}
    assert {p for p in pairs if set(p) <= hot_ids} == {(first_hot, i) for i in hot_ids if i != first_hot}
    assert near_copies.near_copy_pairs(df.limit(0)).count() == 0


def test_an_element_of_many_classes_is_cut_into_blocks():
    """A planted element that every class holds: all pairs of its blocks meet, each once, and no tile holds more than two blocks."""
    n, hot = 600, 50
    rng = np.random.default_rng(15)
    common = np.uint64(1 << 45)
    sets = [np.sort(np.append(rng.integers(0, 1 << 63, 2, dtype=np.uint64), common)) for _ in range(n)]
    freq = np.zeros(near_copies.SKETCH, np.uint8)
    freq[near_copies._slot(np.array([common]))] = 1 + round(np.log2(n) * near_copies.CODE_STEPS)

    class Sent:
        value = freq

    b = pa.RecordBatch.from_arrays([pa.array(np.arange(n)), pa.array([3] * n, pa.int32()), pa.array([b"\0" * 8 * near_copies.BITMAP_WORDS] * n, pa.binary()), pa.array([x.tobytes() for x in sets], pa.binary())], names=["lo", "size", "bitmap", "elements"])
    tiles = 1_000_003
    posted = list(near_copies._prefixes(Sent, 0.0, tiles, 0.2, hot)(iter([b])))
    assert max(len(x) // 8 for p in posted for x in p.column("classes").to_pylist()) < 3 * hot
    got = [(x, y) for r in near_copies._compare(0.2)(iter(posted)) for x, y in zip(r.column("a_lo").to_pylist(), r.column("b_lo").to_pylist(), strict=True)]
    assert len(got) == len(set(got)) and {(min(p), max(p)) for p in got} == {(i, j) for i in range(n) for j in range(i + 1, n)}


def test_copies_up_to_the_limit_are_all_pairs(spark):
    """64 copies give all pairs, 65 the pairs of the smallest id, which also stands for them in pairs with other texts."""
    rng = random.Random(18)
    most = near_copies.ALL_PAIRS_MAX
    a, b = phrase(rng, 40).split(), phrase(rng, 40).split()
    texts = [" ".join(a)] * most + [" ".join(b)] * (most + 1) + [" ".join([*a, "x"]), " ".join([*b, "x"])]
    got = [(r.id_a, r.id_b) for r in near_copies.near_copy_pairs(docs(spark, texts, "method_id", "body")).collect()]
    x = 2 * most + 1
    true = {(i, j) for i in range(most) for j in range(i + 1, most)} | {(i, x) for i in range(most)} | {(most, j) for j in range(most + 1, x)} | {(most, x + 1)}
    assert len(got) == len(set(got)) and set(got) == true


def test_near_copies_hold_little_at_a_time():
    """A large batch is worked on in pieces: the worker's peak does not grow with the batch, and every row comes out."""
    rng = np.random.default_rng(17)
    n, size = 10_000, 110
    x = np.sort(rng.integers(0, 1 << 63, (n, size), dtype=np.uint64), axis=1)
    flat = pa.array([r.tobytes() for r in x], pa.binary())
    keys = pa.array(np.arange(n))
    pairs = pa.RecordBatch.from_arrays([keys, keys, keys, keys, flat, flat], names=["a_hi", "a_lo", "b_hi", "b_lo", "a_elements", "b_elements"])
    texts = pa.RecordBatch.from_arrays([keys, pa.array([" ".join(map(str, r % 1000)) for r in x])], names=["_id", "_text"])
    for f, b in ((near_copies._verify(0.5), pairs), (near_copies._write_sets(3, 20), texts)):
        tracemalloc.start()
        rows = sum(r.num_rows for r in f(iter([b, b.slice(0, 0)])))
        peak = tracemalloc.get_traced_memory()[1] / 1e6
        tracemalloc.stop()
        assert rows == n and peak < 60


# --- 5 ---------------------------------------------------------------------------------------------------------


def test_components(spark):
    rng = random.Random(5)
    edges = [(i, i + 1) for i in range(0, 60)] + [(rng.randrange(100, 300), rng.randrange(100, 300)) for _ in range(90)] + [(500, None), (7, 7)] + [(400, 400 + i) for i in range(1, 50)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if b is not None and a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    got = {r.node: r.root for r in splits.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in parent}
    assert splits.components(spark.createDataFrame([], "a long, b long")).count() == 0


RECORDS = "req_id long, author string, source_doc string, entity string, req_filename string, loaded_at int"


def test_groups_and_splits(spark):
    rows = [
        (1, " Ann@x.org", None, "N/A", "A.txt", 1), (2, "ann", "d/One.pdf", "tbd", "b", 1), (3, "unknown", "C:\\x\\one.doc", "Big Box-1", "c.TXT", 1), (4, "-", "", "bigbox 1", None, 1),
        (5, "n/a", "unknown", " ", "x/E.txt", 1), (6, "UNKNOWN", "n/a", None, "f", 1), (1, " Ann@x.org", None, "N/A", "A.txt", 2), (None, "ann", None, None, "g", 1), (8, "solo", None, None, "h", 1), (9, "solo@y", None, None, "i", 1),
    ]
    df = spark.createDataFrame(rows, RECORDS).withColumn("key", F.lit(1)).withColumn("node", F.lit(2))
    got = {r.req_id: r.group_id for r in splits.related_groups(df).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 5: 5, 6: 6, 8: 8, 9: 8}
    lists = spark.createDataFrame([("chosen", 1, " a.TXT "), ("remaining", 1, "p/B.txt"), ("chosen", 2, "h"), ("chosen", 2, None), ("remaining", 3, " "), ("remaining", 9, "zzz")], "list_name string, line_no long, req_filename string")
    assert {(r.req_id, r.group_id) for r in splits.torn_groups(df, lists).collect()} == {(i, 1) for i in (1, 2, 3, 4)}
    assert splits.torn_groups(df.limit(0), lists).count() == 0
    rng = random.Random(6)
    groups = spark.createDataFrame([(i, g) for i, g in enumerate(x for g in range(60) for x in [g] * rng.randrange(1, 9))], "req_id long, group_id long")
    out = splits.assign_splits(groups).collect()
    by = defaultdict(set)
    for r in out:
        by[r.group_id].add(r.split)
    size = Counter(r.split for r in out)
    n = len(out)
    assert all(len(s) == 1 for s in by.values()) and size["test"] == round(0.1 * n) and size["validation"] == round(0.1 * n) and n == groups.count()
    assert splits.assign_splits(groups.limit(0)).count() == 0


def test_closest_counts():
    rng = random.Random(7)
    for _ in range(200):
        sizes = {rng.randint(1, 12): rng.randint(1, 4) for _ in range(rng.randint(1, 5))}
        target = rng.randint(0, 30)
        c = splits.closest_counts(sizes, target)
        reach = {0}
        for s, k in sizes.items():
            for _ in range(k):
                reach |= {r + s for r in reach}
        total = sum(s * k for s, k in c.items())
        assert all(k <= sizes[s] for s, k in c.items()) and total in reach and abs(total - target) == min(abs(r - target) for r in reach)


def test_filling_counts_beyond_the_window():
    rng = random.Random(14)
    for _ in range(200):
        sizes = {rng.randint(1, 40): rng.randint(1, 30) for _ in range(rng.randint(2, 8))} | {1: 60}
        target = rng.randint(0, sum(s * n for s, n in sizes.items()))
        c = splits.filling_counts(sizes, target, window=50)
        assert all(n <= sizes[s] for s, n in c.items()) and sum(s * n for s, n in c.items()) == target
    assert splits.filling_counts({70: 10}, 1000, 50) == {70: 10}
    assert splits.filling_counts({70: 3, 4: 1}, 142, 5) == {70: 2, 4: 0} or sum(s * n for s, n in splits.filling_counts({70: 3, 4: 1}, 142, 5).items()) in (140, 144)
    assert sum(s * n for s, n in splits.filling_counts({900: 2, 1000: 1}, 1200, 10).items()) == 1000


def test_filling_counts_is_closest_at_any_size():
    """The choice does not depend on the window: with and without it the closest total, and the same groups."""
    assert splits.filling_counts({250_000: 1, 200_000: 2}, 400_000) == {200_000: 2}
    assert splits.filling_counts({3: 60_000, 250_000: 1, 200_000: 2}, 400_000) == splits.closest_counts({3: 60_000, 250_000: 1, 200_000: 2}, 400_000, 1)
    rng = random.Random(16)
    for _ in range(200):
        sizes = {rng.randint(1, 40): rng.randint(1, 9) for _ in range(rng.randint(0, 6))}
        target = rng.randint(0, 300)
        reach = {0}
        for s, n in sizes.items():
            reach = {r + s * k for r in reach for k in range(n + 1)}
        c = splits.filling_counts(sizes, target, window=50)
        total = sum(s * n for s, n in c.items())
        assert all(n <= sizes[s] for s, n in c.items()) and total == min(reach, key=lambda r: (abs(r - target), r)) and c == splits.closest_counts(sizes, target)


# --- 6 ---------------------------------------------------------------------------------------------------------


def test_encoding(spark):
    from tokenizers import Tokenizer

    ref = Tokenizer.from_file(f"{encode.TOKENIZER_DIR}/byte_bpe_50k.json")
    ref.encode_special_tokens = True
    rng = random.Random(8)
    alphabet = " \n\t\r  'sabc12é 　\x1c\x1f\x85​½²ⅧÄ漢字🙂!?.<|>"
    texts = [*ODD, "<|endoftext|> is text", "x" * 3000 + "ab" * 500, "I'll we've  two   spaces \n\n end "] + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(300)]
    got = {r.doc_id: r.ids for r in encode.encode_documents(docs(spark, texts)).collect()}
    for i, t in enumerate(texts):
        assert got[i] == (ref.encode(t, add_special_tokens=False).ids if t else []), repr(t)
    assert encode.encode_documents(docs(spark, texts).limit(0)).count() == 0


# --- 7 ---------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("block", [10, 100_000])
def test_leaks(spark, block):
    rng = random.Random(9)
    items = [phrase(rng, 30) for _ in range(12)] + ["too short", None, " "]
    items.append(" ".join(items[0].split()[5:20] + ["tail"] * 12))
    texts = list(ODD)
    for _ in range(60):
        w = phrase(rng, 60).split()
        if rng.random() < 0.6:
            src = items[rng.randrange(12)].split()
            n = rng.choice([8, 9, 10, 11, 25])
            a = rng.randrange(0, len(src) - n)
            w[20:20] = src[a : a + n]
        texts.append(" ".join(w).upper())
    win = defaultdict(set)
    for i, t in enumerate(items):
        w = words(t)
        for k in range(len(w) - 9):
            win[tuple(w[k : k + 10])].add(i)
    true = {(d, i) for d, t in enumerate(texts) for w in [words(t)] for k in range(len(w) - 9) for i in win.get(tuple(w[k : k + 10]), ())}
    df, q = docs(spark, texts), docs(spark, items, "item_id", extra=False)
    got = leaks.leaked_passages(df.unionByName(df), q, block_windows=block).filter("verbatim").collect()
    assert {(r.doc_id, r.item_id) for r in got} == true and len(got) == len(true)
    assert leaks.leaked_passages(df, q.limit(0)).count() == 0 and leaks.leaked_passages(df.limit(0), q).count() == 0


@pytest.mark.parametrize("least", [0.4, 0.7])
def test_edited_leaks(spark, least):
    rng = random.Random(12)
    items = [phrase(rng, 30) for _ in range(12)] + ["again and " * 8, "too short", None]
    texts = list(ODD) + ["x again and again and again and again y " * 2]
    for _ in range(80):
        w, src = phrase(rng, 40).split(), items[rng.randrange(12)].split()
        n = rng.choice([8, 9, 10, 14])
        a = rng.randrange(0, len(src) - n)
        w[20:20] = src[a : a + n]
        w[20 + rng.randrange(n)] = "changed"
        texts.append(" ".join(w))
    cut = lambda ts: [(i, w[k : k + 10]) for i, t in enumerate(ts) for w in [words(t)] for k in range(len(w) - 9)]
    two = lambda w: set(zip(w, w[1:], strict=False))
    win = [(i, two(w)) for i, w in cut(items)]
    n, df = len({tuple(w) for _, w in cut(items)}), defaultdict(int)
    for w in {tuple(w) for _, w in cut(items)}:
        for p in zip(w, w[1:], strict=False):
            df[p] += 1
    weight = lambda ps: sum(math.log1p(n / max(df.get(p, 1), 1)) for p in ps)
    true = defaultdict(lambda: [0, 0.0])
    for d, w in cut(texts):
        for i, b in win:
            if (a := two(w)) & b and (s := weight(a & b) / weight(a | b)) >= least - 1e-12:
                x = true[d, i]
                x[:] = x[0] + 1, max(x[1], s)
    got = leaks.leaked_passages(docs(spark, texts), docs(spark, items, "item_id", extra=False), radius=None, min_similarity=least).collect()
    assert sum(not r.verbatim for r in got) > (2 if least > 0.5 else 20)
    assert {(r.doc_id, r.item_id): [r.windows, round(r.similarity, 9)] for r in got} == {k: [x, round(s, 9)] for k, (x, s) in true.items()}


def test_hamming_blocks_find_all():
    rng = np.random.default_rng(10)
    ids, texts = list(range(40)), [" ".join(f"w{x}" for x in rng.integers(0, 50, 30)) for _ in range(40)]
    ix = leaks.ItemIndex.build(ids, texts, 10, 3)
    probe = ix.prints[rng.integers(0, len(ix.prints), 500)].copy()
    for _ in range(3):
        probe ^= np.uint64(1) << rng.integers(0, 64, 500).astype(np.uint64)
    pos, k = ix.candidates(probe)
    near = np.bitwise_count(probe[:, None] ^ ix.prints[None]) <= 3
    assert {(a, b) for a, b in zip(pos.tolist(), k.tolist(), strict=True)} == set(zip(*(x.tolist() for x in np.nonzero(near)), strict=True))


# --- 8 ---------------------------------------------------------------------------------------------------------


def test_repetition(spark):
    rng = random.Random(11)
    texts = list(ODD)
    for _ in range(80):
        w = phrase(rng, rng.randrange(3, 120)).split()
        if rng.random() < 0.4:
            w += w[: len(w) * 3 // 4] * rng.randrange(1, 4)
        texts.append(" ".join(w))

    def share(t):
        w, seen, hit = words(t), set(), set()
        for k in range(len(w) - 4):
            g = tuple(w[k : k + 5])
            if g in seen:
                hit |= set(range(k, k + 5))
            seen.add(g)
        return len(hit) / len(w) if w else 0.0

    df = docs(spark, texts)
    rows = repetition.repetitive_documents(df).collect()
    assert {r.doc_id: round(r.run5_share, 9) for r in rows} == {i: round(share(t), 9) for i, t in enumerate(texts)}
    assert {r.doc_id for r in rows if r.confirmed} == {i for i, t in enumerate(texts) if share(t) >= 0.3}
    assert all((r.confirmed is None) == (r.rule is None) for r in rows)
    assert repetition.repetitive_documents(df.limit(0)).count() == 0
    only = docs(spark, ["one two three four five six"] * 3)
    assert repetition.repetitive_documents(only).filter("rule is not null").count() == 0


def test_list_is_learned_on_a_bounded_sample_without_its_label(spark):
    assert repetition.LABEL not in repetition.FEATURES
    rng = np.random.default_rng(13)
    n = 6000
    share = np.where(rng.random(n) < 0.1, rng.uniform(0.4, 1, n), rng.uniform(0, 0.2, n))
    cols = {"doc_id": np.arange(n), "run5_share": share, "run3_share": np.clip(share + rng.uniform(0, 0.1, n), 0, 1), "run8_share": share * rng.uniform(0.5, 1, n)}
    cols |= {f: rng.random(n) for f in repetition.FEATURES if f not in cols}
    import pandas as pd

    stats = spark.createDataFrame(pd.DataFrame(cols)).repartition(5)
    sample = repetition.labelled_sample(stats, 500, n)
    assert len(sample) == 500
    rules = repetition.learned_rules(stats, n, 500)
    unseen = ~np.isin(cols["doc_id"], sample["doc_id"])
    hit, y = np.logical_or.reduce([repetition._holds(r, cols, n) for r in rules])[unseen], (share >= 0.3)[unseen]
    assert hit[y].mean() == 1 and y[hit].mean() > 0.5  # one row in ten is positive
    # nothing to learn from: the rule that holds for every positive document
    assert repetition.learned_rules(stats.filter("run5_share < 0.3"), n, 500) == [repetition.last_rule()]


def test_decision_list_learns_a_conjunction():
    rng = np.random.default_rng(12)
    x = {"a": rng.random(2000), "b": rng.random(2000), "noise": rng.random(2000)}
    y = (x["a"] > 0.6) & (x["b"] < 0.3) | (x["a"] < 0.1)
    rules = repetition.learn_decision_list(x, y)
    hit = np.logical_or.reduce([np.logical_and.reduce([c.holds(x) for c in r]) for r in rules])
    assert (hit == y).mean() > 0.98 and all(len(r) <= repetition.MAX_CONDITIONS for r in rules)
    assert repetition.learn_decision_list(x, np.zeros(2000, bool)) == [] and repetition.learn_decision_list(x, np.ones(2000, bool)) == [[]]
    assert re.search("CASE WHEN", str(repetition.as_expression(rules)))
