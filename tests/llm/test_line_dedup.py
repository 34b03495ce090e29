import random
import re
import time

from pyspark.sql import functions as F

from tessera.llm import line_dedup


def words(line):
    return re.findall(r"[^\x20\x09-\x0D]+", line)


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) <= 1
    if abs(len(a) - len(b)) != 1:
        return False
    a, b = (a, b) if len(a) > len(b) else (b, a)
    return any(a[:i] + a[i + 1 :] == b for i in range(len(a)))


def brute(docs, min_words=1, near_words=5):
    """{doc_id: dropped line numbers}, for documents by rising id."""
    seen, out = [], {}
    for doc, text in docs:
        for i, line in enumerate((text or "").split("\n")):
            own = words(line)
            if len(own) < min_words:
                continue
            if any(
                own == x or (min(len(own), len(x)) >= near_words and near(own, x)) for x in seen
            ):
                out.setdefault(doc, []).append(i)
            seen.append(own)
    return out


def sample(seed=3, n=60):
    rng = random.Random(seed)
    vocabulary = ["the", "of", "a"] + [f"w{i}" for i in range(40)]
    pool = [[rng.choice(vocabulary) for _ in range(rng.choice([1, 4, 5, 9, 10, 11, 12, 20, 35]))] for _ in range(40)]
    pool.append(["the"] * 14)
    docs = []
    for i in range(n):
        lines = []
        for _ in range(rng.randint(0, 6)):
            line = list(rng.choice(pool))
            for _ in range(rng.choice([0, 0, 1, 1, 2])):
                at, what = rng.randrange(len(line)), rng.randrange(3)
                if what == 0:
                    line[at] = rng.choice(vocabulary)
                elif what == 1:
                    line.insert(at, rng.choice(vocabulary))
                elif len(line) > 1:
                    del line[at]
            lines.append(rng.choice([" ", "  ", "\t"]).join(line))
        docs.append((i, "\n".join(lines)))
    docs += [(n, None), (n + 1, ""), (n + 2, "\n\n"), (n + 3, " ".join(vocabulary * 60)), (n + 4, " ".join(vocabulary * 60 + ["x"]))]
    return docs


def test_matches_brute_force(spark):
    docs = sample()
    df = spark.createDataFrame([(t, i, "x") for i, t in docs], "text string, doc_id long, line string").repartition(3)
    got = {r["doc_id"]: r["dropped"] for r in line_dedup.report(df).collect()}
    want = brute(docs)
    assert len(want) > 30
    assert got == {i: ",".join(map(str, want.get(i, []))) for i, _ in docs}


def test_stage(spark):
    line = " ".join(f"w{i}" for i in range(30))
    rows = [
        (1, f"{line}\nown words here", "a", 5),
        (2, f"{line}\nown words there too", "a", 5),
        (3, f"{line} more\n{' '.join(f'v{i}' for i in range(40))}", "a", 5),
        (4, None, "a", 0),
        (None, "x", "b", 1),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long")
    got = {r["doc_id"]: r for r in line_dedup.drop_repeated_lines(df).collect()}
    assert set(got) == {1, 2, 3, 4, None}
    assert got[2]["text"] == "own words there too"
    assert got[1]["text"] == rows[0][1] and got[1]["n_chars"] == 5
    assert got[3]["text"] == rows[2][1].split("\n")[1] and got[3]["n_chars"] == len(got[3]["text"])
    empty = df.where("false")
    assert line_dedup.drop_repeated_lines(empty).count() == line_dedup.report(empty).count() == 0


def test_repeated_rows(spark):
    line = " ".join(f"w{i}" for i in range(12))
    df = spark.createDataFrame([(1, line), (1, line), (2, line)], "doc_id long, text string")
    got = sorted((r["doc_id"], r["n_dropped"]) for r in line_dedup.report(df).collect())
    assert got == [(1, 0), (1, 0), (2, 1)]


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_bound_grows_with_the_line(spark):
    """Against brute force: one edit for each ten words of the shorter line."""
    rng = random.Random(8)
    vocabulary = ["the", "of", "a"] + [f"w{i}" for i in range(60)]
    sizes = [3, 5, 9, 10, 18, 19, 20, 21, 29, 30, 38, 39, 40, 41, 42, 55, 80, 130]
    pool = [[rng.choice(vocabulary) for _ in range(n)] for n in sizes for _ in range(2)]
    docs, seen, want = [], [], {}
    for doc in range(150):
        lines = []
        for i in range(rng.randint(1, 4)):
            line = list(rng.choice(pool))
            for _ in range(rng.randint(0, len(line) // 10 + 1)):
                at, what = rng.randrange(len(line)), rng.randrange(3)
                line[at : at + (what > 0)] = [rng.choice(vocabulary)] * (what < 2)
            least = [min(len(line), len(x)) for x in seen]
            if any(line == x or m >= 5 and distance(line, x) <= max(1, m // 10) for x, m in zip(seen, least, strict=True)):
                want.setdefault(doc, []).append(i)
            seen.append(line)
            lines.append(" ".join(line))
        docs.append((doc, "\n".join(lines)))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = line_dedup.dropped_lines(df, min_words=1, near_words=5, words_per_edit=10)
    assert {r["doc_id"]: r["dropped"] for r in got.collect()} == want
    one = line_dedup.dropped_lines(df)
    assert one.select(F.sum(F.size("dropped"))).first()[0] < sum(map(len, want.values()))


def test_pipeline_takes_short_lines(spark):
    import corpus_pipeline

    long = [" ".join(f"{c}{i}" for i in range(12)) for c in "abc"]
    docs = [(1, f"one line\nfive words are too few\n{long[0]}"), (2, f"{long[1]}\none line\n\nfive words were too few"), (3, f"one  line\n{long[2]}\nother line")]
    got = corpus_pipeline.lines(spark, spark.createDataFrame(docs, "doc_id long, text string"), "")
    assert {r["doc_id"]: r["text"] for r in got.collect()} == {1: docs[0][1], 2: f"{long[1]}\n", 3: f"{long[2]}\nother line"}


def test_pipeline_keeps_a_documents_own_words(spark):
    import corpus_pipeline

    shared, later = (" ".join(f"{c}{i}" for i in range(n)) for c, n in (("s", 60), ("t", 8)))
    docs = [(1, shared), (2, f"{shared}\n{later}"), (3, f"{later}\nnothing else is here"), (4, shared)]
    got = corpus_pipeline.lines(spark, spark.createDataFrame(docs, "doc_id long, text string"), "")
    assert {r["doc_id"]: r["text"] for r in got.collect()} == {1: shared, 2: later, 3: "nothing else is here"}


def test_names_that_clash(spark):
    """Columns named as inner ones come through with their own values."""
    line = " ".join(f"w{i}" for i in range(12))
    names = ["_id", "_digest", "_dropped", "_left", "_own_digest", "row", "dropped", "digest", "left", "own", "id", "n", "place", "line", "a.b"]
    fields = ", ".join(f"`{c}` string" for c in names)
    rows = [(1, line, *names), (2, f"{line}\nanother line", *names), (3, line, *names)]
    df = spark.createDataFrame(rows, f"doc_id long, text string, {fields}")
    got = sorted(line_dedup.drop_repeated_lines(df).collect())
    assert [tuple(r) for r in got] == [rows[0], (2, "another line", *names)]
    assert sorted((r["doc_id"], r["dropped"]) for r in line_dedup.report(df).collect()) == [(1, ""), (2, "0"), (3, "0")]


def test_copies_go_first(spark):
    """With least_left a line's last holder doesn't go with a document that is a copy."""
    shared, kept = (" ".join(f"{c}{i}" for i in range(n)) for c, n in (("s", 60), ("t", 8)))
    docs = [(1, shared), (2, f"{shared}\n{kept}"), (3, f"{kept}\nnothing else is here"), (4, shared)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = line_dedup.drop_repeated_lines(df, least_left=0.2)
    assert {r["doc_id"]: r["text"] for r in got.collect()} == {1: shared, 3: f"{kept}\nnothing else is here"}


def test_long_lines_and_texts(spark):
    """A line of 20,000 words against one with a word exchanged, and a text of 20,000
    lines that all stand in an earlier one."""
    long = [f"w{i}" for i in range(20_000)]
    other = [*long[:10_000], "x", *long[10_001:]]
    many = "\n".join(f"line number {i % 10_000} of the text" for i in range(20_000))
    docs = [(1, " ".join(long)), (2, " ".join(other)), (3, many), (4, f"{many}\nits own words come last here")]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    start = time.time()
    got = {r["doc_id"]: r["n_dropped"] for r in line_dedup.report(df).collect()}
    assert got[1] == 0 and got[2] == 1 and got[4] == 20_000
    assert time.time() - start < 120
