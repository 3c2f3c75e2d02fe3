import random
import re

from pyspark.sql import functions as F

from mustra.llm import line_dedup, queries


def brute(texts, min_docs=3, spread=0.75):
    """Positions of the lines to drop, per distinct text."""

    def words(line):
        return [w for w in re.split(r"\s+", re.sub(r"(?<!\S)[^\s\d]*\d\S*", "<*>", line, flags=re.ASCII), flags=re.ASCII) if w]

    def leaf(w):
        return (len(w), *w[:2])

    def fields(w):
        rest, m = len(w) - 2, min(8, len(w) - 2)
        return tuple(tuple(w[2 + j * rest // m : 2 + (j + 1) * rest // m]) for j in range(m))

    lines, count = [], {}
    for t in set(texts):
        parsed = [words(x) for x in t.split("\n")]
        for i, w in enumerate(parsed):
            if len(w) >= 3:
                around = (leaf(parsed[i - 1]) if i else None, leaf(parsed[i + 1]) if i + 1 < len(parsed) else None)
                lines.append((t, i, leaf(w), fields(w), around))
                count.setdefault(leaf(w), {}).setdefault(fields(w), [0])[0] += 1
    template = {}
    for lf, shapes in count.items():
        most = max(n for (n,) in shapes.values())
        tops = [f for f, (n,) in shapes.items() if n == most]
        assert len(tops) == 1 or most < min_docs, "the example must not rest on ties"
        for f in shapes:
            same = sum(a == b for a, b in zip(f, tops[0], strict=True))
            template[lf, f] = (lf, tops[0] if same >= 0.7 * len(f) else f)
    held, places = {}, {}
    for t, _, lf, f, around in lines:
        held.setdefault(template[lf, f], set()).add(t)
        places.setdefault(template[lf, f], set()).add(around)
    gone = {x for x in held if len(held[x]) >= min_docs and len(places[x]) >= max(min_docs, spread * len(held[x]))}
    out = {t: set() for t in texts}
    for t, i, lf, f, _ in lines:
        if template[lf, f] in gone:
            out[t].add(i)
    return out


def example():
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    line = lambda n=12: " ".join(word() for _ in range(n))
    passage = " ".join(word() for _ in range(60))
    texts = []
    for i in range(40):
        body = [line() for _ in range(4)]
        if i % 3 == 0:
            body.insert(rng.randrange(5), f"Page {i} of this report was printed on day {i * 7} for internal use")
        if i % 4 == 0:
            body.insert(rng.randrange(5), passage)
        texts.append("\n".join(body))
    base = [line() for _ in range(8)]
    for i in range(6):  # near copies: the same surroundings
        texts.append("\n".join([*base[:-1], base[-1] + " " + word()]))
    return texts, passage, base


def test_templates_go_and_copies_stay(spark):
    texts, passage, base = example()
    texts += [texts[1]] * 5 + ["", "a b\n\nc"]
    docs = spark.createDataFrame([(i, t, 7) for i, t in enumerate(texts)] + [(None, None, 7)], "doc_id long, text string, at int")
    rows = line_dedup.clean(docs, counts=True).collect()
    assert len(rows) == len(texts) + 1
    expected = brute(texts)
    for r in rows:
        if r.doc_id is not None:
            lines = texts[r.doc_id].split("\n")
            assert r.text == "\n".join(x for i, x in enumerate(lines) if i not in expected[texts[r.doc_id]])
            assert r.n_dropped == len(expected[texts[r.doc_id]])
    kept = "\n".join(r.text or "" for r in rows)
    assert passage not in kept and "internal use" not in kept and base[0] in kept
    cleaned = line_dedup.drop_emptied(docs)
    assert cleaned.columns == docs.columns
    assert line_dedup.clean(docs.limit(0)).count() == 0


def test_emptied_documents_go(spark):
    rows = [(i, f"first words {w} zz\nsome common line of every page here\nlast words {w} yy", 0) for i, w in enumerate("abcd")]
    rows = [(i, t.replace("words", "words " * (i + 1)), n) for i, t, n in rows] + [(9, "some common line of every page here", 0), (10, "", 0)]
    out = {r.doc_id: r for r in line_dedup.drop_emptied(spark.createDataFrame(rows, "doc_id long, text string, n_chars long")).collect()}
    assert 9 not in out and 10 in out and all("common" not in r.text and r.n_chars == len(r.text) for r in out.values())


def test_query_returns_every_document(spark, sf_dir):
    assert queries.op10_line_dedup(spark, sf_dir).count() == spark.read.parquet(f"{sf_dir}/documents.parquet").count()


def test_documents_lose_what_recurs_and_nothing_that_does_not(spark):
    """Bounds by brute force, without hashes: a line that is alike (through others of its leaf) in fewer than three texts stays;
    one that stands word for word in three texts, no two of which have much else in common, goes."""

    def words(line):
        return ["<*>" if re.search("[0-9]", w) else w for w in re.split(r"[ \t\n\r\f\x0B]+", line) if w]

    def fields(w):
        rest, m = len(w) - 2, min(8, len(w) - 2)
        return tuple(tuple(w[2 + j * rest // m : 2 + (j + 1) * rest // m]) for j in range(m))

    docs = {r.doc_id: r.text or "" for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    leaves, traits = {}, {}
    for t in set(docs.values()):
        parsed = [words(x) for x in t.split("\n")]
        traits[t] = {x for w in parsed if w for x in ((len(w), *w[:2]), ("head", *w[:3]), ("tail", *w[-3:]))}
        for w in parsed:
            if len(w) >= 3:
                leaves.setdefault((len(w), *w[:2]), {}).setdefault(fields(w), set()).add(t)
    spared, doomed = set(), set()
    for leaf, shapes in leaves.items():
        left = set(shapes)
        while left:
            reached, new = set(), {left.pop()}
            while new:
                reached |= new
                new = {f for f in left if any(sum(a == b for a, b in zip(f, g, strict=True)) >= 0.7 * len(f) - 1e-9 for g in new)}
                left -= new
            if len(set().union(*(shapes[f] for f in reached))) < 3:
                spared |= {(leaf, f) for f in reached}
        for f, texts in shapes.items():
            apart = []
            for t in sorted(texts):
                if all(len(traits[t] & traits[o]) <= 0.1 * len(traits[t] | traits[o]) for o in apart):
                    apart.append(t)
            if len(apart) >= 12:  # more than three, as even such texts may share a band by chance
                doomed.add((leaf, f))
    assert spared and doomed
    kept = {r.doc_id: r.text.split("\n") for r in queries.op10_line_dedup(spark, "/root/testdata/sf0.01").collect()}
    for i, text in docs.items():
        shapes = [((len(w), *w[:2]), fields(w)) if len(w) >= 3 else None for w in map(words, text.split("\n"))]
        rest = [((len(w), *w[:2]), fields(w)) if len(w) >= 3 else None for w in map(words, kept[i])]
        assert [s for s in shapes if s in spared] == [s for s in rest if s in spared]
        assert not doomed & set(rest)


def prose(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    return lambda n=8: [" ".join(word() for _ in range(12)) for _ in range(n)]


def cleaned(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r.text for r in line_dedup.clean(docs).orderBy("doc_id").collect()]


def test_copies_do_not_save_a_recurring_line(spark):
    some = prose(3)
    shared, base = "this very line stands in all of these documents", some()
    texts = ["\n".join([*some(4), shared, *some(4)]) for _ in range(20)]
    for i in range(40):  # near copies, all with the line; every one has a word more in one of its lines
        lines = [x + f" {some(1)[0][:5]}" * (j == i % 8) for j, x in enumerate(base)]
        texts.append("\n".join([*lines[:4], shared, *lines[4:]]))
    out = cleaned(spark, texts)
    assert all(shared not in t for t in out)
    assert all(t == x.replace(shared + "\n", "") for t, x in zip(out, texts, strict=True))


def test_passages_between_blank_lines_and_blocks_go(spark):
    some = prose(4)
    passage, block = some(1)[0], some(4)
    texts = ["\n".join([*some(5), "", passage, "", *some(4)]) for _ in range(8)]
    texts += ["\n".join([passage, "", *some(5)]) for _ in range(2)] + ["\n".join([*some(5), "", passage]) for _ in range(2)] + [passage]
    texts += ["\n".join([*some(5), *block, *some(5)]) for _ in range(12)]
    out = "\n".join(cleaned(spark, texts)).split("\n")
    gone = {passage, *block}
    assert not gone & set(out)
    assert sorted(x for x in out if x) == sorted(x for t in texts for x in t.split("\n") if x and x not in gone)


def greedy(shapes, need):
    """The template of each (fields, n), one leaf's, taken one after the other."""
    left, out = sorted(shapes, key=lambda x: (x[1], x[2]), reverse=True), {}
    while left:
        top = left[0][0]
        for f in [f for f, *_ in left if sum(a == b for a, b in zip(f, top, strict=True)) >= need]:
            out[f] = top
        left = [x for x in left if x[0] not in out]
    return out


def test_a_leaf_has_all_its_templates(spark):
    rng = random.Random(5)
    for m, need in ((8, 6), (5, 4), (2, 2)):
        seen = {tuple(rng.randrange(3 if m > 2 else 9) for _ in range(m)) for _ in range(60)}
        lines = [(7, list(f)) for f in sorted(seen) for _ in range(rng.randrange(1, 6))]
        frame = spark.createDataFrame(lines, "leaf long, fields array<int>")
        ids = {tuple(r.fields): r.id for r in frame.selectExpr("fields", "xxhash64(leaf, fields) AS id").distinct().collect()}
        counts = [(f, sum(tuple(x) == f for _, x in lines), ids[f]) for f in seen]
        expected = greedy(counts, need)
        got = {tuple(r.fields): r.template for r in line_dedup.templates(frame, 1).collect()}
        assert got == {f: ids[t] for f, t in expected.items()}


def test_forms_with_names_go_beside_a_more_frequent_line(spark):
    some = prose(6)
    top = "This form was handed in by nobody at all on the last of days"
    texts = ["\n".join([*some(3), top, *some(3)]) for _ in range(12)]
    name = lambda: some(1)[0][:5]
    forms = [f"This form was signed for the office by clerk {name()} in the town hall" for _ in range(9)]
    assert len(top.split()) == len(forms[0].split())
    texts += ["\n".join([*some(3), x, *some(3)]) for x in forms]
    out = cleaned(spark, texts)
    assert not any("This form" in t for t in out) and all(len(t.split("\n")) == 6 for t in out)


def test_very_long_texts_and_lines(spark):
    shared = " ".join(f"passage{i}" for i in range(30))
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(8))
    rows = [(i, "\n".join([" ".join(word() for _ in range(9)) for _ in range(4000)] + [shared])) for i in range(4)]
    rows += [(9, "one line " * 60_000), (10, "x" * 300_000), (11, "\n" * 200_000)]
    out = {r.doc_id: r for r in line_dedup.clean(spark.createDataFrame(rows, "doc_id long, text string"), counts=True).collect()}
    assert all(out[i].n_dropped == 1 and out[i].n_lines == 4001 and out[i].text.rstrip("\n") == rows[i][1].removesuffix(shared).rstrip("\n") for i in range(4))
    assert all(out[i].text == t and out[i].n_dropped == 0 for i, t in rows[4:])


def test_a_class_of_edited_copies_is_one_group(spark):
    """Lines of a chain of copies, each an edit of the one before, stay; a line that unrelated texts share goes."""
    rng = random.Random(5)
    lines, chain = prose(77)(12), []
    for i in range(40):
        at = rng.randrange(len(lines))
        lines[at] = f"edit{chr(97 + i % 26)}{chr(97 + i // 26)} " + lines[at].partition(" ")[2]
        chain.append("\n".join(lines))
    shared = "this very line stands in many texts that have nothing else in common"
    others = ["\n".join([*prose(500 + i)(), shared]) for i in range(6)]
    got = cleaned(spark, chain + others)
    assert got[: len(chain)] == chain
    assert got[len(chain) :] == [t.rpartition("\n")[0] for t in others]


def test_groups_are_the_components_of_close_texts(spark):
    """Groups follow the links of texts that are alike to their ends, and keep unrelated texts apart."""
    base = prose(31)(12)
    near = ["\n".join([*base[:i], f"own{chr(97 + i)} words begin and end this line of text{chr(97 + i)}", *base[i + 1 :]]) for i in range(5)]
    apart = ["\n".join(prose(900 + i)()) for i in range(8)]
    docs = spark.createDataFrame(list(enumerate(near + apart)), "doc_id long, text string")
    keys = [r.key for r in docs.select("doc_id", line_dedup.text_key(F.col("text")).alias("key")).orderBy("doc_id").collect()]
    found = {bytes(r.key): r.group for r in line_dedup.copy_groups(line_dedup.parse_lines(docs).filter("tokens > 0")).collect()}
    assert len({found.get(bytes(k), bytes(k)) for k in keys[5:]}) == 8
    own = {r.key: r.mark for r in docs.select(line_dedup.text_key(F.col("text")).alias("key")).select("key", F.xxhash64("key").alias("mark")).collect()}
    assert len({found.get(bytes(k), own[k]) for k in keys[:5]}) == 1


def test_fields_are_runs_of_words(spark):
    """Of lines of any number of words, and the whole line is parsed once before it is staged."""
    lines = [" ".join(f"w{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10]}" for i in range(n)) for n in range(60)]
    frame = spark.createDataFrame([("\n".join(lines),)], "text string")
    wanted = spark.createDataFrame([(n, [" ".join(w[2 + j * r // m : 2 + (j + 1) * r // m]) for j in range(m)]) for n, x in enumerate(lines) for w in [x.split()] for r in [max(len(w) - 2, 0)] for m in [min(8, r)]], "at int, parts array<string>")
    hashed = {r.at: r.fields for r in wanted.select("at", F.transform("parts", lambda x: F.hash(x)).alias("fields")).collect()}
    got = {r.at: r for r in line_dedup.parse_lines(frame).collect()}
    assert {at: r.fields for at, r in got.items()} == hashed and [got[n].tokens for n in range(60)] == list(range(60))


def test_lines_are_parsed_once(spark, monkeypatch):
    plans, stage = [], line_dedup.stage
    monkeypatch.setattr(line_dedup, "stage", lambda df: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or stage(df))
    line_dedup.recurring_lines(line_dedup.parse_lines(spark.createDataFrame([("a b c\n\n \t",)], "text string")))
    assert plans[0].count("replace(") == 1 and plans[0].lower().count("rlike(") <= 2
