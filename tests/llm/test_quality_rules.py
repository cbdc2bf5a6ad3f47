import math
import random

from pyspark.sql import functions as F

from memloom.llm import quality_rules as q


def naive(text):
    words = q.WORDS.findall(text)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    covered = {j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(i, i + 8)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if q.WORDS.search(line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for w in words for c in w), dup, len(covered)


def test_measures():
    rng = random.Random(3)
    for _ in range(200):
        text = "".join(rng.choice(["a ", "b ", "c#", "\n", " ", "é", "\t", "x y z u v w a b "]) for _ in range(rng.randint(0, 120)))
        assert q.measures(text)[:5] == naive(text)


def test_binomial_upper():
    for k, n, level in ((0, 100, 0.05), (3, 200, 0.01), (10, 40, 0.05)):
        p = q.binomial_upper(k, n, level)
        tail = sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))
        assert abs(tail - level) < 1e-6


def test_rejects_junk_and_keeps_good(spark):
    rng = random.Random(1)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(500)]
    rows, labels = [], []
    for d in range(3000):
        junk = d % 6 == 0
        text = " ".join(rng.choice(words) + ("&&&" if junk else "") for _ in range(60))
        rows.append((d, text, "en" if d % 3 else "fr"))
        labels.append((d, 0 if junk else 1))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = q.apply_rules(docs, spark.createDataFrame(labels, "doc_id long, quality int"))
    kept = got.groupBy(F.col("doc_id") % 6 == 0).agg(F.avg(F.col("kept").cast("int")).alias("k")).collect()
    rate = {r[0]: r.k for r in kept}
    assert rate[True] < 0.05
    assert rate[False] > 0.98


def naive_cutoffs(rows, alpha, delta):
    """Level and cutoffs of each stratum by enumeration over ``rows(tag, stratum, good, base_failed, bins)``."""
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    hashed = {r.tag: r.h for r in spark.createDataFrame([(t,) for t in sorted({r[0] for r in rows})], "tag long").select("tag", F.pmod(F.xxhash64(F.lit("half"), "tag"), F.lit(10)).alias("h")).collect()}
    strata = sorted({r[1] for r in rows})
    out = {}
    for name in [*strata, q.POOL]:
        texts = {}
        for tag, s, good, failed, bins in rows:
            if name in (s, q.POOL):
                old = texts.get((s, tag))
                texts[s, tag] = (good and (old is None or old[0]), failed, bins)
        good = [(tag, failed, bins) for (_, tag), (g, failed, bins) in texts.items() if g]
        chosen = [b for tag, failed, b in good if hashed[tag] < q.SELECTING and not failed]
        held = [(failed, b) for tag, failed, b in good if hashed[tag] >= q.SELECTING]
        if not chosen or not held:
            continue
        grid = []
        for m in q.MARGINS:
            grid.append([min(q.STEPS, max(b[i] for b in chosen) + m) for i in range(len(q.RULES))])
        for level in q.LEVELS:
            grid.append([min(v for v in {b[i] for b in chosen} if sum(b[i] > v for b in chosen) / len(chosen) <= level) for i in range(len(q.RULES))])
        share = delta / 2 if name == q.POOL else delta / 2 / len(strata)
        best = -1
        for k, cut in enumerate(grid):
            rejected = sum(not failed and any(x > c for x, c in zip(b, cut, strict=True)) for failed, b in held)
            if q.binomial_upper(rejected, len(held), share) > alpha:
                break
            best = k
        if best >= 0:
            out[name] = (best, grid[best])
    return out


def test_cutoffs_against_enumeration(spark):
    rng = random.Random(6)
    rows = []
    for d in range(2600):
        stratum = "en" if d % 4 else "fr"
        bins = tuple(min(q.STEPS, int(abs(rng.gauss(8, 5 + 3 * i / 8)))) for i in range(len(q.RULES)))
        rows.append((d // 2 if d % 50 == 0 else d, stratum, rng.random() < 0.8, rng.random() < 0.05, bins))
    frame = spark.createDataFrame([(*r[:4], *r[4]) for r in rows], f"tag long, stratum string, good boolean, base_failed boolean, {', '.join(f'{r} int' for r in q.RULES)}")
    # equal texts have equal measures
    first = {}
    rows = [(t, s, g, *first.setdefault((s, t), (f, b))) for t, s, g, f, b in rows]
    frame = spark.createDataFrame([(*r[:4], *r[4]) for r in rows], frame.schema)
    for alpha in (0.02, 0.06):
        got = {r.stratum: (r.level, list(r.cutoffs)) for r in q.cutoffs(frame, alpha, 0.05).collect()}
        assert got == naive_cutoffs(rows, alpha, 0.05)
    assert got


def test_limits_that_pass():
    for k, n, level, alpha in ((0, 150, 0.025, 0.02), (0, 190, 0.025, 0.02), (3, 400, 0.01, 0.02), (2, 700, 0.01, 0.02), (5, 5, 0.1, 0.5)):
        assert q.passes(k, n, level, alpha) == (q.binomial_upper(k, n, level) <= alpha)


def test_decides_on_given_tables(spark):
    """On the small table the pool's cutoffs reject texts that the base rules keep, and few good ones."""
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    got = q.apply_rules(spark.read.parquet(f"{sf}/documents.parquet"), labels)
    rejected = got.filter("not base_failed and not kept")
    assert rejected.count() > 0 and {r.guarantee for r in got.select("guarantee").distinct().collect()} <= {"pool", "stratum"}
    good = labels.filter("quality = 1").select("doc_id")
    assert rejected.join(good, "doc_id").count() <= 0.02 * good.count()
