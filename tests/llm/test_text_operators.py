import hashlib
import itertools
import re

import pytest

from spanwise.llm import chat, decontaminate, jaccard

SAID = "\\### Assistant: </turn> ok"


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def test_chat_round_trip(spark):
    rows = [
        (1, 0, "user", SAID), (1, 1, "assistant", "a\\\n</turn>\n### user: x"), (1, 2, "user", None), (1, 3, "assistant", ""), (1, 3, "assistant", ""),
        (2, 0, "we:ird\\", "####### <</turn>"), (3, None, "assistant", "é😀"), (3, 1, None, "b"), (None, 1, "assistant", "n"),
    ]
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, example string")
    got = {r.conv_id: r for r in chat.digests(chat.prefix_target_examples(df)).collect()}
    assert set(got) == {1, 2, 3, None}
    for conv, r in got.items():
        turns = sorted((x for x in rows if x[0] == conv), key=lambda x: (x[1] is not None, x[1] or 0, x[2] or "", x[3] or ""))
        assert (r.n_turns, r.turns_sha256) == (len(turns), sha("".join(f"{t[2] or ''}\n{t[3] or ''}\n" for t in turns)))
        loss = "".join(t[3] or "" for t in turns if t[2] == "assistant")
        assert (r.loss_chars, r.loss_sha256) == (len(loss), sha(loss))
    examples = chat.prefix_target_examples(df).where("conv_id = 1").orderBy("example").collect()
    assert len(examples) == 3 and all(b.text.startswith(a.text) for a, b in itertools.pairwise(examples))
    assert chat.digests(chat.prefix_target_examples(df.limit(0))).count() == 0


def test_chat_escapes_every_control_string(spark, rng):
    """Random texts over what control strings are made of: the formatted text holds those of the template alone, and gives the texts back."""
    parts = ["#", "\\", "</turn>", " ", "### ", "\n", ": ", "/", "a", "<", "####"]
    rows = [(i, k, rng.choice(["assistant", "user", "#a: b", "\\"]), "".join(rng.choice(parts) for _ in range(rng.randrange(9)))) for i in range(150) for k in range(3)]
    rows += [(900, 0, "user", "#### Assistant: x"), (901, 0, "assistant", "#" * 100_000 + "</turn>" * 1_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    for r in chat.prefix_target_examples(df).where("last").collect():
        want = [x for x in rows if x[0] == r.conv_id]
        assert r.text.count("### ") == r.text.count("</turn>") == len(want)
    got = {r.conv_id: r.turns_sha256 for r in chat.digests(chat.prefix_target_examples(df)).collect()}
    for conv in got:
        assert got[conv] == sha("".join(f"{t[2]}\n{t[3]}\n" for t in rows if t[0] == conv))


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items):
    out = []
    for doc in docs:
        w, hit, found = words(doc[1]), set(), set()
        for item, text in items:
            iw = words(text)
            k = min(13, len(iw))
            for j in range(len(iw) - k + 1 if k else 0):
                for i in range(len(w) - k + 1):
                    if w[i : i + k] == iw[j : j + k]:
                        hit |= set(range(i, i + k))
                        found.add(item)
        out.append((doc[0], len(w), len(hit), len(found), sha(",".join(sorted(map(str, found)))), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


@pytest.mark.parametrize("limit", [60_000, 0])
def test_decontamination(spark, make_docs, rng, limit, monkeypatch):
    monkeypatch.setattr(decontaminate, "SEGMENT", 40)
    text = lambda n: " ".join(rng.choice("ab") + str(rng.randrange(3)) for _ in range(n))
    items = [(i, text(rng.choice([3, 12, 13, 14, 30]))) for i in range(12)] + [(90, None), (91, ""), (10, "Ünïq ÉÉ"), (92, "same same same same same same same same same same same same same same same")]
    docs = [(i, text(40) + " " + rng.choice(items[:12])[1].upper() if i % 2 else text(90)) for i in range(14) if i != 10]
    docs = [(i, t) for i, t in docs] + [(50, None), (51, "  --"), (52, "ünïq éé"), (53, "ünïq ÉÉ"), (54, "same " * 100), (None, items[3][1]), (1, docs[0][1]), (1, docs[0][1])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    monkeypatch.setattr(decontaminate, "contamination", lambda d, b, f=decontaminate.contamination: f(d, b, broadcast_rows=limit))
    got = sorted((tuple(r) for r in decontaminate.contamination_report(make_docs(docs), bench).collect()), key=str)
    assert got == brute(docs, items)
    if limit:
        assert decontaminate.contamination_report(make_docs(docs).limit(0), bench).count() == 0
        assert decontaminate.contamination_report(make_docs(docs), bench.limit(0)).where("n_hit > 0").count() == 0
        kept = decontaminate.clean(make_docs(docs), bench)
        assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r[0]) for r in got if not r[5])


def row_components(docs):
    """(doc_id, shingles, component) of each row in order, by comparing all pairs."""
    sets = []
    for _, t in docs:
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")) if x]
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    up = list(range(len(docs)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, j in itertools.combinations(range(len(docs)), 2):
        if sets[i] and docs[i][0] is not None and docs[j][0] is not None and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
            up[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(docs):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return [(d, len(s), None if d is None else least[find(i)]) for i, ((d, _), s) in enumerate(zip(docs, sets, strict=True))]


def components(docs):
    return sorted(row_components(docs), key=str)


@pytest.mark.parametrize("chunk,routed,common", [(1 << 19, 32, 100_000), (150, 32, 3), (150, 1, 0), (60, 2, 100_000)])
def test_jaccard_components(make_docs, rng, chunk, routed, common, monkeypatch):
    monkeypatch.setattr(jaccard, "CHUNK_SHINGLES", chunk)
    monkeypatch.setattr(jaccard, "ROUTED", routed)
    monkeypatch.setattr(jaccard, "COMMON", common)
    monkeypatch.setattr(jaccard, "SPREAD", 3)
    base = [[f"w{rng.randrange(400)}" for _ in range(rng.randrange(30, 90))] for _ in range(12)]
    shared = [f"s{i}" for i in range(25)]
    docs = []
    for i in range(70):
        w = list(base[i % 12])
        for _ in range(rng.randrange(0, 4)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(1000)}"
        docs.append((i, " ".join(w + shared * (i % 3 == 0))))
    docs += [(100, docs[3][1].upper()), (101, None), (102, " \n"), (103, "one two"), (104, "ONE\ttwo"), (105, "one two three"), (None, docs[0][1]), (7, docs[7][1]), (7, docs[7][1])]
    got = sorted((tuple(r) for r in jaccard.shingle_components(make_docs(docs)).collect()), key=str)
    assert got == components(docs)
    if chunk > 1000:
        left = sorted(str(r.doc_id) for r in jaccard.one_of_each(make_docs(docs)).collect())
        assert left == sorted({str(d) for d, n, c in got if d == c or n == 0})
        assert jaccard.shingle_components(make_docs(docs).limit(0)).count() == 0


def test_one_of_each_keeps_other_texts_of_an_id(make_docs):
    a, b, c = (" ".join(f"{x}{i}" for i in range(20)) for x in "abc")
    rows = [(3, a), (7, a), (7, b), (8, c), (8, c), (8, c.upper()), (9, b + " more"), (9, None), (9, None), (None, a), (None, a), (10, "x" * 200_000), (11, "w " * 60_000)]
    df = make_docs(rows).withColumnsRenamed({"source": "__id", "lang": "__key", "sig": "prefix"})
    left = jaccard.one_of_each(df)
    assert left.columns == df.columns
    got = sorted(((r.doc_id, r.text) for r in left.collect()), key=str)
    kept = [(3, a), (7, b), (9, None), (9, None), (None, a), (None, a), (10, "x" * 200_000), (11, "w " * 60_000)]
    assert got in (sorted([*kept, (8, x)], key=str) for x in (c, c.upper()))


def test_native_operators_run_no_python(spark, make_docs):
    """The plans of the two operators that are to be native hold no Python worker."""
    docs, bench = make_docs([(1, "a b c")]), spark.createDataFrame([(1, "a b c d")], "item_id long, text string")
    turns = spark.createDataFrame([(1, 0, "user", "x"), (1, 1, "assistant", "y")], "conv_id long, turn long, role string, text string")
    for df in (chat.digests(chat.prefix_target_examples(turns)), decontaminate.contamination_report(docs, bench)):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert not any(x in plan for x in ("Python", "Arrow", "Pandas", "MapPartitions"))


def test_very_long_rows(spark, make_docs, rng):
    """Texts of a megabyte beside short ones."""
    long = " ".join(f"w{rng.randrange(10**6)}" for _ in range(120_000))
    docs = make_docs([(1, long), (2, long + " end"), (3, "short text"), (4, "x" * 1_000_000)])
    got = {r.doc_id: r for r in jaccard.shingle_components(docs).collect()}
    assert got[2].component_id == 1 and got[1].n_shingles > 119_000 and got[4].n_shingles == 1
    words_ = long.split()
    bench = spark.createDataFrame([(7, " ".join(words_[70_000:70_013]))], "item_id long, text string")
    report = {r.doc_id: r for r in decontaminate.contamination_report(docs, bench).collect()}
    assert report[1].n_hit == 13 and report[1].n_words == 120_000 and not report[1].contaminated and report[4].n_words == 1
    turns = spark.createDataFrame([(1, 0, "user", long), (1, 1, "assistant", long)], "conv_id long, turn long, role string, text string")
    assert chat.digests(chat.prefix_target_examples(turns)).first().loss_chars == len(long)
