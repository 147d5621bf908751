import random
import time
from collections import Counter

from leadweave.llm import decontaminate as d
from tests.llm.cases import odd_docs, prose, unchanged


def shingles(words, width):
    return [tuple(words[i:i + width]) for i in range(len(words) - width + 1)]


def brute(docs, items):
    cut = lambda t: [w.decode() for w in (t or "").encode().lower().split()]
    best = {}
    for doc, text in docs:
        words = cut(text)
        for item, wanted in items:
            wanted = cut(wanted)
            width = min(5, len(wanted))
            if not width:
                continue
            target = Counter(shingles(wanted, width))
            for start in range(max(1, len(words) - len(wanted) + 1)):
                window = Counter(shingles(words[start:start + len(wanted)], width))
                smaller, larger = sum((window & target).values()), sum((window | target).values())
                if 100 * smaller >= 80 * larger and smaller / larger > best.get((doc, item), (0, 0))[0]:
                    best[doc, item] = (smaller / larger, start)
    return best


def test_planted_windows(spark):
    rng = random.Random(2)
    items = [(i, prose(50 + i, n)) for i, n in enumerate((40, 40, 15, 60, 5, 3, 1, 33))] + [(90, None), (91, " \n"), (92, "same same same same same same same other same same same same"), (0, prose(50, 40))]
    texts = {i: t for i, t in items}
    edited = texts[0].split()
    edited[1] = "changed"
    docs = [(1, f"{prose(1)} {texts[0]} {prose(2)}"), (2, f"{prose(3)} {' '.join(edited)} {prose(4)}"), (3, f"{prose(5)} {texts[1].upper()}"), (4, " ".join(texts[3].split()[:-4])), (5, f"{texts[2]}\n{texts[2]}"),
            (6, f"{prose(6)} {texts[5]}"), (7, texts[6]), (8, prose(8)), (9, texts[92]), (10, " ".join(texts[7].split()[:15]) + " " + prose(9)), (11, f"{prose(11, 20000)} {texts[4]}"), (None, texts[0])]
    rng.shuffle(docs)
    got = d.matches(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    want = brute(docs, items)
    assert {(r.doc, r.item): (r.similarity, r.start) for r in got} == want and len(got) == len(want)


def test_odd_rows(spark):
    docs, items = odd_docs(spark), spark.createDataFrame([(1, prose(8)), (2, None)], "item_id long, text string")
    kept = d.without_benchmark(docs, items)
    unchanged(kept, docs.filter("doc_id IS NULL OR doc_id NOT IN (8, 9)"))
    assert d.matches(docs.limit(0), items).count() == 0 and d.matches(docs, items.limit(0)).count() == 0


def test_blocks_find_every_print_within_the_radius(spark):
    rng = random.Random(1)
    pairs = []
    for _ in range(300):
        a = rng.getrandbits(64)
        b = a
        for bit in rng.sample(range(64), d.RADIUS):
            b ^= 1 << bit
        pairs.append((a - (1 << 63), b - (1 << 63)))
    found = spark.createDataFrame(pairs, "a long, b long").select(d.blocks("a").alias("x"), d.blocks("b").alias("y")).collect()
    assert all(any(p == q for p, q in zip(r.x, r.y)) for r in found)


def test_simhash_counts_every_bit(spark):
    rng = random.Random(6)
    rows = [([rng.getrandbits(64) - (1 << 63) for _ in range(n)] * (1 + n % 3),) for n in (1, 2, 3, 7, 36, 63)]
    got = spark.createDataFrame(rows, "hashes array<long>").select("hashes", d.simhash("hashes", 8).alias("print")).collect()
    for r in got:
        bits = sum((2 * sum(h >> j & 1 for h in r.hashes) > len(r.hashes)) << j for j in range(64))
        assert r.print % (1 << 64) == bits


def test_edited_windows_near_the_threshold(spark):
    """Windows of similarity 0.80 to 0.85: the exact way loses none, fingerprints at most two of a hundred, and neither finds anything else."""
    rng = random.Random(12)
    items, docs = [], []
    for i in range(500):
        n = rng.choice((32, 41, 42, 50, 59, 68, 77))
        words = prose(20000 + i, n).split()
        items.append((i, " ".join(words)))
        lost = (n - 4) // 9  # shingles: as many as a similar window can lack
        start = [f"new{i}x{k}" for k in range(lost)] + words[lost:]
        at = rng.randrange(4, n - 4 - lost)
        inner = words[:at] + [f"new{i}x{k}" for k in range(lost - 4)] + words[at + max(0, lost - 4):]
        docs += [(2 * i + k, f"{prose(50000 + 2 * i + k, 30)} {' '.join(edited)} {prose(60000 + 2 * i + k, 30)}") for k, edited in enumerate((start, inner))]
    frames = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    found = [{(r.doc, r.item): (r.similarity, r.start) for r in d.matches(*frames, exact=exact).collect()} for exact in (True, False)]
    want = {}
    for doc, text in docs:
        want |= brute([(doc, text)], [items[doc // 2]])
    assert len(want) == len(docs) and sum(similarity <= 0.85 for similarity, _ in want.values()) > 500
    assert found[0] == want
    # a lost best window may leave another similar one of the same document and item
    assert len(found[1]) >= 0.98 * len(want) and sum(want[k] == v for k, v in found[1].items()) >= 0.98 * len(want)
    assert all(0.8 <= similarity <= want[k][0] for k, (similarity, _) in found[1].items())


def test_a_long_item_costs_seconds(spark):
    """An item of 5,000 words in a document of 6,000; one that repeats itself, so that counts matter."""
    long, twice = prose(1, 5000), f"{prose(2, 400)} {prose(2, 400)}"
    docs = spark.createDataFrame([(1, f"{prose(3, 500)} {long} {prose(4, 500)}"), (2, f"{prose(5, 50)} {twice}")], "doc_id long, text string")
    items = spark.createDataFrame([(1, long), (2, twice)], "item_id long, text string")
    started = time.time()
    got = {(r.doc, r.item): (r.similarity, r.start, r.distance) for r in d.matches(docs, items).collect()}
    assert got == {(1, 1): (1.0, 500, 0), (2, 2): (1.0, 50, 0)} and time.time() - started < 120


def test_weighted_jaccard(spark):
    rng = random.Random(4)
    pairs = [([rng.randrange(7) for _ in range(rng.randint(1, 12))], [rng.randrange(7) for _ in range(rng.randint(1, 12))]) for _ in range(300)]
    for r in spark.createDataFrame(pairs, "a array<long>, b array<long>").withColumn("j", d.weighted_jaccard("a", "b")).collect():
        a, b = Counter(r.a), Counter(r.b)
        assert (r.j.smaller, r.j.larger) == (sum((a & b).values()), sum((a | b).values()))
