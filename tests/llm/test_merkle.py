import hashlib
import random
import re
import zlib
from collections import Counter

import pytest

from mustra.llm import merkle, queries


def test_documents(spark, sf_dir):
    docs = sorted(((r.doc_id, r.text or "") for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()), reverse=True)
    rows = {r.doc_id: r for r in queries.op9_fingerprints(spark, sf_dir).collect()}
    assert len(rows) == len(docs)
    likelier = 0
    for (id_, text), (_, following) in zip(docs, docs[1:] + docs[:1], strict=True):
        third, r = len(text) // 3, rows[id_]
        changed = text[: len(text) - third] + following[:third]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(changed.encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == (merkle.fingerprint(text).text, merkle.fingerprint(changed).text)
        assert r.near_edited == merkle.likeness(*map(merkle.parse, (r.fingerprint, r.edited_fingerprint)))
        assert r.near_next == merkle.likeness(merkle.fingerprint(text), merkle.fingerprint(following))
        likelier += r.near_edited > r.near_next
    assert likelier / len(docs) > 0.95


def test_roots_and_branches():
    text = "One here. Two there.\nSecond line.\n\nNew section! Yes.\nLast."
    tree = merkle.fingerprint(text)
    assert merkle.parse(tree.text) == tree and merkle.likeness(tree, tree) == 1
    other = merkle.fingerprint(text.replace("Yes", "No"))
    assert other.root != tree.root and 0.5 < merkle.likeness(tree, other) < 1
    assert merkle.differences(tree.text, other.text) == [(1, 0)] and merkle.differences(tree.text, tree.text) == []
    rng = random.Random(3)
    seen = {}
    for _ in range(3000):
        t = "".join(rng.choice("ab .\n!") for _ in range(rng.randrange(12)))
        assert seen.setdefault(merkle.fingerprint(t).root, t) == t


def test_order_over_ranges_and_hard_rows(spark):
    rng = random.Random(9)
    rows = [(rng.randrange(40), "x" * rng.randrange(9) + str(i % 7)) for i in range(90)] + [(None, "n"), (None, None), (3, None), (5, "long " * 60_000)]
    order = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is None, -(r[0] or 0), r[1].encode()))
    expected = sorted((i, hashlib.sha256(merkle.edited(t, n).encode()).hexdigest()) for (i, t), (_, n) in zip(order, order[1:] + order[:1], strict=True) if i is not None)
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, fingerprint int")
    for ranges in (1, 2, 7, 60):
        got = merkle.neighbour_likeness(docs, ranges=ranges).collect()
        assert len(got) == len(rows)
        assert sorted((r.doc_id, r.edited_sha256) for r in got if r.doc_id is not None) == expected
    alone = merkle.neighbour_likeness(docs.filter("doc_id = 5").limit(1)).collect()
    assert len(alone) == 1 and alone[0].near_next == 1
    assert merkle.neighbour_likeness(docs.limit(0)).count() == 0 == merkle.fingerprint_documents(docs.limit(0)).count()


def plain(text):
    """Root, and characters by leaf, found another way: the text is cut character by character."""
    h = lambda *parts: hashlib.blake2b(b"".join(parts), digest_size=32).digest()
    lines, sections, leaves = text.splitlines(keepends=True), [[]], {}
    for i, line in enumerate(lines):
        sections[-1].append(line)
        if i + 1 < len(lines) and not line.strip() and lines[i + 1].strip() and len(sections[-1]) > 1:
            sections.append([])
    tops = []
    for section in sections if text else []:
        nodes = []
        for line in section:
            below, sentence, sentences = [], "", []
            for i, c in enumerate(line):
                sentence += c
                rest = line[i + 1 :]
                if sentence.strip(".!?\n ") != sentence.rstrip() and re.search(r"[.!?]\s*$", sentence) and rest and not re.match(r"[.!?\s]", rest):
                    sentences.append(sentence)
                    sentence = ""
            for s in [*sentences, sentence] if sentence else sentences:
                held = ""
                for word in re.findall(r"\S+\s*|\s+", s) if len(s) > 64 else [s]:
                    held += word
                    if len(s) > 64 and (len(held) >= 256 or zlib.crc32(word.strip().encode()) % 8 == 0):
                        below.append(held)
                        held = ""
                below += [held] if held else []
            for leaf in below:
                leaves[leaf] = leaves.get(leaf, 0) + len(leaf)
            nodes.append(h(b"p", *(h(x.encode()) for x in below)))
        tops.append(h(b"s", *nodes))
    return h(b"r", *tops).hex(), leaves


def test_trees_and_likeness_against_another_way():
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(1, 9)))
    sentence = lambda: " ".join(word() for _ in range(rng.randrange(1, 30))) + rng.choice([". ", "! ", "? "])
    line = lambda: "".join(sentence() for _ in range(rng.randrange(1, 5))).strip() + "\n"
    texts = ["\n".join("".join(line() for _ in range(rng.randrange(1, 4))) for _ in range(rng.randrange(1, 5))) for _ in range(60)]
    texts += [a[: len(a) // 2] + b[len(b) // 2 :] for a, b in zip(texts, texts[1:], strict=False)]
    known = [(merkle.fingerprint(t), *plain(t)) for t in texts]
    assert all(tree.root == root for tree, root, _ in known)
    for (a, _, x), (b, _, y) in zip(known, known[1:] + known[60:61], strict=True):
        common = 2 * sum(min(n, y.get(leaf, 0)) for leaf, n in x.items()) / (a.size + b.size)
        assert abs(merkle.likeness(a, b) - (1 if a.root == b.root else common)) < 1e-12


def test_ids_are_integers(spark):
    with pytest.raises(TypeError):
        merkle.neighbour_likeness(spark.createDataFrame([("a", "t")], "doc_id string, text string"))


SCRIPTS = {
    "stops": lambda rng: "".join("".join(chr(rng.randrange(0x4E00, 0x9FA0)) for _ in range(rng.randrange(5, 40))) + rng.choice("。！？") for _ in range(200)),
    "no stops": lambda rng: "".join(chr(rng.randrange(0x4E00, 0x9FA0)) for _ in range(6000)),
    "letters": lambda rng: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6000)),
    "wide": lambda rng: "".join(chr(rng.randrange(0x1F300, 0x1F600)) for _ in range(3000)),
}


@pytest.mark.parametrize("script", SCRIPTS)
def test_texts_without_white_space(script):
    rng = random.Random(script)
    text, other = SCRIPTS[script](rng), SCRIPTS[script](rng)
    tree = merkle.fingerprint(text)
    like = lambda changed: merkle.likeness(tree, merkle.fingerprint(changed))
    assert 0.5 < like(merkle.edited(text, other)) < 0.8
    assert 0.95 < like(text[:1000] + "x" + text[1000:]) < 1 and like(text[:-1]) > 0.95
    assert like(other) < 0.05 and like(str(text)) == 1
    assert "".join(merkle._leaves(text)) == text and max(map(len, merkle._leaves(text))) <= merkle.LEAF_MOST + merkle.LEAF_CHARS


def test_leaves_of_one_character_again_and_again_and_of_blanks():
    for text in ("a" * 5000, " " * 5000, "ab" * 3000, "。" * 300, "a" * 65, "é" * 64):
        assert "".join(merkle._leaves(text)) == text and len(list(merkle._leaves(text))) <= 1 + len(text) / merkle.PIECE_LEAST


def brute_likeness(a, b):
    """Over the multisets of leaves as texts."""
    one, two = (Counter(leaf for s in merkle._sections(t) for p in s.splitlines(keepends=True) for leaf in merkle._leaves(p)) for t in (a, b))
    return 1.0 if a == b else 2 * sum(len(x) * min(n, two[x]) for x, n in one.items()) / (len(a) + len(b))


def test_likeness_equals_brute_force_in_any_script():
    rng = random.Random(9)
    for _ in range(40):
        text = rng.choice(list(SCRIPTS.values()))(rng)[: rng.randrange(900)] + rng.choice(["\n\n", "\n", " ", "。"]) + rng.choice(list(SCRIPTS.values()))(rng)[: rng.randrange(900)]
        other = merkle.edited(text, text[::-1])
        assert merkle.likeness(merkle.fingerprint(text), merkle.fingerprint(other)) == pytest.approx(brute_likeness(text, other))
