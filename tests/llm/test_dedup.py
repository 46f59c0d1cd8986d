import hashlib
import random

import numpy as np
import pytest

from llm_fixtures import texts_table, words  # noqa: F401
from turnlake.llm import parsing_dedup, simhash, suffix_dedup
from turnlake.llm import windows as w


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def bytes_by_definition(texts, size):
    seen, out = set(), {}
    for d, text in texts:
        body = (text or "").encode()
        gone = bytearray(len(body))
        for s in range(len(body) - size + 1):
            if body[s:s + size] in seen:
                gone[s:s + size] = b"\1" * size
            seen.add(body[s:s + size])
        runs = sum(1 for i in range(len(body)) if gone[i] and not (i and gone[i - 1]))
        out[d] = (len(body), sum(gone), runs, sha(bytes(x for x, g in zip(body, gone) if not g)))
    return out


def words_by_definition(texts, size):
    first, out = {}, {}
    for d, text in texts:
        ws = (text or "").encode().split()
        for s in range(len(ws) - size + 1):
            first.setdefault(tuple(ws[s:s + size]), d)
    for d, text in texts:
        ws = (text or "").encode().split()
        gone = [False] * len(ws)
        for s in range(len(ws) - size + 1):
            if first[tuple(ws[s:s + size])] < d:
                gone[s:s + size] = [True] * size
        out[d] = (len(ws), sum(gone), sha(b" ".join(x for x, g in zip(ws, gone) if not g)))
    return out


def by_id(df, *columns):
    return {r[0]: tuple(r[1:]) for r in df.select("doc_id", *columns).collect()}


@pytest.mark.parametrize("seed", range(4))
def test_suffix_array_orders_all_suffixes(seed):
    draw = random.Random(seed)
    alphabet = ["a", "ab", "abc\0", "".join(map(chr, range(97, 123)))][seed]
    text = "".join(draw.choice(alphabet) for _ in range(400)).encode() + b"aaaaabaaaaab" * 5
    got = suffix_dedup.suffix_array(np.frombuffer(text, np.uint8), len(text))
    assert got.tolist() == sorted(range(len(text)), key=lambda i: text[i:])


def test_low_suffixes_are_smaller_than_their_successors():
    text = b"mississippi$aab"
    low = suffix_dedup.low_suffixes(np.frombuffer(text, np.uint8))
    assert low.tolist() == [text[i:] < text[i + 1:] and i + 1 < len(text) for i in range(len(text))]


def test_repeated_bytes(texts_table, words):
    got = by_id(suffix_dedup.deduplicated(texts_table), "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got == bytes_by_definition(list(enumerate(words)), 100)
    assert sum(x[1] for x in got.values()) > 1000


def test_repeated_words(texts_table, words):
    got = by_id(parsing_dedup.deduplicated(texts_table), "n_words", "n_removed", "kept_sha256")
    assert got == words_by_definition(list(enumerate(words)), 13)
    assert sum(x[1] for x in got.values()) > 500


@pytest.mark.parametrize("at_once", [130, 700])
def test_long_texts_are_worked_on_in_parts(spark, texts_table, words, at_once):
    """Parts far smaller than the texts, and grams ranked as frequent, change nothing."""
    for module, cells, define, columns in (
            (suffix_dedup, suffix_dedup.bytes_of(100), bytes_by_definition, ("n_bytes", "n_removed")),
            (parsing_dedup, parsing_dedup.words_of(13), words_by_definition, ("n_words", "n_removed"))):
        small = w.Cells(cells.window, cells.gram, cells.read, cells.grams, cells.probes, at_once, cells.within_document)
        spans = w.repeated_spans(texts_table, small, lambda b, m=module, n=cells.window: m.judge(b, n), "parts")
        covered = {r.doc_id: len({i for s in r.spans for i in range(s.start, s.end)}) for r in spans.collect()}
        wanted = {d: x[1] for d, x in define(list(enumerate(words)), cells.window).items() if x[1]}
        assert covered == wanted


def test_frequent_grams_only_change_the_order():
    values = np.frombuffer(b"the quick brown fox jumps over the lazy dog and on it went for a while longer. " * 4, np.uint8)
    cells = suffix_dedup.bytes_of(100)
    first = np.array([0, len(values)])
    table = np.zeros(1 << w.FREQUENT_BITS, bool)
    table[::2] = True
    for frequent in (None, table):
        s = w.stretches(values, first, cells, frequent)
        assert s.n.sum() == len(values) - 99
        assert np.unique(np.concatenate([np.arange(a, a + n) for a, n in zip(s.start, s.n)])).size == len(values) - 99
        # Equal windows lie at the same place of equal grams.
        text, key = values.tobytes(), {}
        for a, o, n, g in zip(s.start, s.offset, s.n, s.gram):
            for i in range(n):
                assert key.setdefault(text[a + i:a + i + 100], (g, o - i)) == (g, o - i)


def test_null_and_repeated_ids(spark):
    text = "the same passage of more than one hundred bytes, which is said again and again by everyone who ever says it at all"
    rows = spark.createDataFrame([(None, text), (3, text), (3, text), (5, text), (7, None)], "doc_id long, text string")
    got = sorted((str(r.doc_id), r.n_removed) for r in suffix_dedup.deduplicated(rows).collect())
    assert got == [("3", 0), ("3", 0), ("5", len(text)), ("7", 0), ("None", 0)]
    got = sorted((str(r.doc_id), r.n_removed) for r in parsing_dedup.deduplicated(rows).collect())
    assert got == [("3", 0), ("3", 0), ("5", len(text.split())), ("7", 0), ("None", 0)]


def test_repeated_ids_with_other_texts(spark, words):
    """Every text of an id is a document: one at the place of the id, the others behind all, in the order of id and hash."""
    draw = random.Random(11)
    given = [(draw.randrange(12), t) for t in words for _ in range(draw.choice([1, 1, 2]))] + [(None, words[0]), (3, None), (40, words[1])]
    rows = spark.createDataFrame(given, "doc_id long, text string")
    digest = {r.text: r.h for r in rows.selectExpr("text", "xxhash64(text) as h").collect()}
    several = {d: sorted({t for e, t in given if e == d and t is not None}, key=digest.get) for d in {d for d, _ in given if d is not None}}
    ordered = [(d, several[d][0]) for d in sorted(several)] + [(d, t) for d in sorted(several) for t in several[d][1:]]
    for run, define, size, columns in (
            (suffix_dedup.deduplicated, bytes_by_definition, 100, ("n_bytes", "n_removed", "n_spans", "kept_sha256")),
            (parsing_dedup.deduplicated, words_by_definition, 13, ("n_words", "n_removed", "kept_sha256"))):
        wanted = dict(zip(ordered, define(list(enumerate(t for _, t in ordered)), size).values()))
        alone = lambda t: define([(0, t)], size)[0] if t is None else (
            len(t.encode()) if size == 100 else len(t.encode().split()), 0, *((0,) * (size == 100)), sha(t.encode() if size == 100 else b" ".join(t.encode().split())))
        expected = sorted(str((d, *(wanted[d, t] if (d, t) in wanted else alone(t)))) for d, t in given)
        got = run(rows).select("doc_id", *columns).collect()
        assert sorted(str(tuple(r)) for r in got) == expected


def test_windows_that_do_not_fit_are_refused(spark):
    rows = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    with pytest.raises(ValueError):
        suffix_dedup.deduplicated(rows, window=287)


def test_kept_text_is_text(spark):
    text = "".join(map(chr, range(192, 272)))
    # Ā and À share their second byte, so the cut goes through a character.
    rows = spark.createDataFrame([(1, text), (2, "abĀ" + text[1:60] + "!")], "doc_id long, text string")
    assert by_id(suffix_dedup.deduplicated(rows, with_text=True), "clean_text") == {1: (text,), 2: ("ab!",)}
    assert by_id(parsing_dedup.deduplicated(rows, with_text=True), "clean_text")[1] == (text,)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert suffix_dedup.deduplicated(none).count() == 0
    assert parsing_dedup.deduplicated(none).count() == 0
    assert simhash.grouped(none).count() == 0
    assert simhash.near_duplicates(none).count() == 0


# ------------------------------------------------------------------------------------------------ SimHash
def print_by_definition(text):
    import xxhash
    lower = bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode())
    ws = lower.split()
    if not ws:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(ws[i:i + 4]), 42) for i in range(max(1, len(ws) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_groups(texts_table, words):
    wanted = [print_by_definition(t) for t in words]
    root = list(range(len(words)))
    changed = True
    while changed:
        changed = False
        for i in range(len(words)):
            for j in range(len(words)):
                if bin(wanted[i] ^ wanted[j]).count("1") <= 4 and root[j] < root[i]:
                    root[i], changed = root[j], True
    rows = simhash.grouped(texts_table)
    got = by_id(rows.select("doc_id", simhash.hex_of("fingerprint").alias("h"), "component_id"), "h", "component_id")
    assert got == {i: ("%016x" % wanted[i], root[i]) for i in range(len(words))}


def test_long_texts_are_hashed_in_parts(spark, monkeypatch):
    text = "B " + " ".join(str(i % 97) for i in range(5000))
    monkeypatch.setattr(simhash, "SHINGLES_AT_ONCE", 300)
    lists = list(simhash.shingle_hashes(text, 4, 42))
    assert len(lists) > 10
    total = sum(simhash._bit_sums(x, [len(x)])[0] for x in lists)
    n = sum(map(len, lists))
    assert int(np.packbits(2 * total > n).view(">u8")[0]) == print_by_definition(text)


def test_forest_finds_all_pairs():
    draw = np.random.default_rng(3)
    base = draw.integers(0, 1 << 63, 6, dtype=np.uint64)
    values = np.unique(np.concatenate([b ^ (np.uint64(1) << draw.integers(0, 64, 40, dtype=np.uint64)) for b in base]))
    shard = np.sort(draw.integers(0, 3, len(values)))
    shard = np.unique(shard, return_inverse=True)[1]
    found = {(min(a, b), max(a, b)) for x, y in simhash.Forest(shard, values).near(4) for a, b in zip(x.tolist(), y.tolist())}
    wanted = {(i, j) for i in range(len(values)) for j in range(i + 1, len(values))
              if shard[i] == shard[j] and int(values[i] ^ values[j]).bit_count() <= 4}
    assert found == wanted


def test_bands_share_two_when_few_bits_differ():
    bands = simhash.bands(4)
    assert sum(mask.bit_length() for _, mask in bands) == 64
    assert [at for at, _ in bands] == [sum(m.bit_length() for _, m in bands[:i]) for i in range(6)]


def test_chains_and_stars_become_components(spark):
    from turnlake.llm.components import components
    chain = [(i, i + 1) for i in range(0, 40)]
    star = [(1000, i) for i in range(1001, 1060)]
    got = {r.node: r.root for r in components(spark.createDataFrame(chain + star + [(7, 7)], "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 1000 for i in range(1000, 1060)}}


def test_near_duplicates_by_similarity(spark):
    draw = random.Random(5)
    base = [f"w{draw.randrange(5000)}" for _ in range(400)]
    near = list(base)
    near[50] = near[300] = "changed"
    far = list(base)
    for i in range(0, 400, 12):
        far[i] = "other"
    other = [f"w{draw.randrange(5000)}" for _ in range(400)]
    rows = spark.createDataFrame([(9, " ".join(base)), (4, " ".join(near)), (6, " ".join(far)), (8, " ".join(other)),
                                  (11, " ".join(base)), (20, None), (21, "")], "doc_id long, text string")
    assert by_id(simhash.near_duplicates(rows), "component_id") == {9: (4,), 4: (4,), 11: (4,), 6: (6,), 8: (8,), 20: (20,), 21: (20,)}


def test_near_duplicates_take_rows_of_an_id_as_one(spark):
    draw = random.Random(31)
    say = lambda: " ".join(f"w{draw.randrange(10 ** 6)}" for _ in range(60))
    a, b, c = say(), say(), say()
    rows = spark.createDataFrame([(5, a), (5, b), (3, b), (7, a + " more"), (9, c), (9, c), (11, c + " more"), (12, say())], "doc_id long, text string")
    got = {(r.doc_id, r.component_id) for r in simhash.near_duplicates(rows).collect()}
    assert got == {(5, 3), (3, 3), (7, 3), (9, 9), (11, 9), (12, 12)}


def test_texts_alone_are_told_from_texts_with_a_similar_one(spark):
    """Copies do not count for each other, a shared passage does not do, and no text with a similar one is alone."""
    draw = random.Random(37)
    say = lambda n: [f"w{draw.randrange(10 ** 6)}" for _ in range(n)]
    passage, texts = say(60), {}
    for i in range(30):
        base = say(200)
        texts[4 * i] = texts[4 * i + 1] = " ".join(base + passage)
        texts[4 * i + 2] = " ".join(base[:100] + say(5) + base[100:] + passage) if i % 2 else " ".join(say(100) + passage + say(100))
        texts[4 * i + 3] = " ".join(say(draw.randrange(1, 9)))
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    import numpy as np
    rows = simhash.shingle_rows(docs, np.zeros(0, np.uint64), 5, 0.8)
    lonely = {r.mark for r in simhash.alone(rows).collect()}
    lost = {r.doc_id for r in rows.collect() if r.mark in lonely}
    wanted = components_by_brute_force({i: t for i, t in texts.items()})
    sets = {i: frozenset(shingles_of(t)) for i, t in texts.items()}
    similar = {i for i in texts for j in texts if sets[i] != sets[j] and sets[i] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])}
    long = {4 * i + k for i in range(0, 30, 2) for k in range(3)}
    assert not lost & similar and long <= lost and len(similar) >= 45 and not long & similar
    assert {r.doc_id: r.component_id for r in simhash.near_duplicates(docs).collect()} == wanted


def shingles_of(text):
    words = text.split()
    return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def components_by_brute_force(texts):
    """The smallest id reachable over pairs of shingle sets alike to 0.8 or more."""
    sets = {i: shingles_of(t) for i, t in texts.items()}
    root = {i: i for i in texts}
    pairs = [(i, j) for i in texts for j in texts if i < j and len(sets[i] & sets[j]) / max(1, len(sets[i] | sets[j])) >= 0.8]
    changed = True
    while changed:
        changed = False
        for i, j in pairs:
            low = min(root[i], root[j])
            changed |= root[i] != low or root[j] != low
            root[i] = root[j] = low
    return root


def test_near_duplicates_around_the_threshold(spark):
    draw = random.Random(17)
    texts, alike = {}, []
    say = lambda n: [f"w{draw.randrange(10 ** 6)}" for _ in range(n)]
    for n in (9, 14, 24, 90, 400):
        for k in range(60):
            base, other = say(n), None
            aim = 0.75 + 0.1 * (k % 12) / 11
            # A changed tail of x words makes a similarity of (n - 4 - x) / (n - 4 + x).
            x = round((n - 4) * (1 - aim) / (1 + aim))
            other = base[:n - x] + say(x)
            texts[2 * len(alike)], texts[2 * len(alike) + 1] = " ".join(base), " ".join(other)
            alike.append((n - 4 - x) / (n - 4 + x))
    assert sum(0.75 <= a < 0.8 for a in alike) > 50 and sum(0.8 <= a <= 0.85 for a in alike) > 50
    rows = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(rows).collect()}
    assert got == {i: i - i % 2 if alike[i // 2] >= 0.8 else i for i in texts}


@pytest.mark.parametrize("cluster", [1, 20, 4000])
def test_near_duplicates_of_a_common_line_and_of_templates(spark, monkeypatch, cluster):
    """One line in all texts, and templates whose copies are partly near: small goes, as for a large shard."""
    monkeypatch.setattr(simhash, "CELLS_AT_ONCE", 500)
    monkeypatch.setattr(simhash, "CLUSTER_ITEMS", cluster)
    draw = random.Random(23)
    say = lambda n: [f"w{draw.randrange(10 ** 6)}" for _ in range(n)]
    line, texts = say(12), {}
    for t in range(6):
        base = say(60)
        for _ in range(15):
            words = list(base)
            for _ in range(draw.randrange(4)):
                words[draw.randrange(60)] = "x" + say(1)[0]
            texts[len(texts)] = " ".join(words + line)
    for _ in range(40):
        texts[len(texts)] = " ".join(say(20) + line)
    ids = list(texts)
    draw.shuffle(ids)
    rows = spark.createDataFrame([(i, texts[i]) for i in ids], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(rows).collect()}
    wanted = components_by_brute_force(texts)
    assert got == wanted and len(set(wanted.values())) > 46


def test_near_duplicates_with_a_repeated_line(spark):
    """A line said many times adds few shingles to the set but most of the counts."""
    draw = random.Random(29)
    say = lambda n: [f"w{draw.randrange(10 ** 6)}" for _ in range(n)]
    texts = {}
    for times in (10, 20, 40, 80):
        for _ in range(5):
            base = say(400)
            texts[len(texts)] = " ".join(base)
            texts[len(texts)] = " ".join(base + say(8) * times)
    line = say(8)
    texts[len(texts)], texts[len(texts)] = " ".join(line * 9), " ".join(line * 15)
    rows = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: (r.component_id, r.fingerprint) for r in simhash.near_duplicates(rows).collect()}
    assert {i: c for i, (c, _) in got.items()} == {i: i - i % 2 for i in texts} == components_by_brute_force(texts)
    assert got[40][1] == got[41][1]


def test_trees_find_near_duplicates_first(spark, monkeypatch):
    """Links of fingerprints, checked on the sets, are found without the search by prefixes; texts of other similarity are not."""
    draw = random.Random(41)
    say = lambda n: [f"w{draw.randrange(10 ** 6)}" for _ in range(n)]
    texts = {}
    for i in range(20):
        base = say(1500)
        texts[2 * i], texts[2 * i + 1] = " ".join(base), " ".join(base[:700] + ["x"] + base[700:])
    line = say(8)
    texts[40], texts[41] = " ".join(line * 9), " ".join(line * 15)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    searched = {}

    def spied(sets, known, frequent, similarity):
        searched["known"] = {(r.item, r.group) for r in known.collect()}
        return spark.createDataFrame([], "a long, b long")

    monkeypatch.setattr(simhash, "similar_links", spied)
    prints = {r.doc_id: int(r.fingerprint) for r in simhash.near_duplicates(docs).collect()}
    linked = {2 * i for i in range(20) if ((prints[2 * i] ^ prints[2 * i + 1]) & (2 ** 64 - 1)).bit_count() <= 4}
    assert len(linked) >= 15 and searched["known"] == {(i + 1, i) for i in linked}
    # A cloud is not yet a pair: fingerprints within any distance, sets that have nothing in common.
    apart = spark.createDataFrame([(1, " ".join(say(50))), (2, " ".join(say(50)))], "doc_id long, text string")
    assert {(r.doc_id, r.component_id) for r in simhash.near_duplicates(apart, radius=6).collect()} == {(1, 1), (2, 2)}


def test_sets_of_one_group_are_told_from_the_start():
    """Three sets, the first two known as one: the third joins by the one it is similar to."""
    a, b = np.arange(100, dtype=np.uint64), np.arange(1000, 1100, dtype=np.uint64)
    body = np.concatenate((a, b, np.arange(1005, 1105, dtype=np.uint64)))
    first = np.array([0, 100, 200, 300])
    assert simhash.similar_sets(np.zeros(3, np.int64), first, body, 0.8).tolist() == [0, 1, 1]
    assert simhash.similar_sets(np.zeros(3, np.int64), first, body, 0.8, np.array([0, 0, 2])).tolist() == [0, 0, 0]
