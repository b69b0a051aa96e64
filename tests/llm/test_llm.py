import random

import numpy as np
import pytest

from corpusloom.llm import mixing, neardup, packing, scans, similar, splitting, subjects


def test_split_limits_offsets_and_edges(spark):
    rng = random.Random(1)
    texts = ["", None, "short", "x" * 700, " ".join(rng.choice(["alpha", "beta.", "gamma"]) for _ in range(400)), "。".join("漢字" * 9 for _ in range(40)), "a. b\n\n" * 150]
    items = spark.createDataFrame([("s", None if i == 3 else f"i{i}", t, 1) for i, t in enumerate(texts)] * 2, "item_kind string, item_id string, content string, piece int")
    got = splitting.split_oversized(items, 50, 10).collect()
    by = {}
    for r in got:
        by.setdefault(r.item_id, []).append((r.piece_no, r.start_offset, r.end_offset, r.piece))
    want = {(None if i == 3 else f"i{i}"): t for i, t in enumerate(texts) if t and len(t) > 203}
    assert set(by) == set(want)
    for k, pieces in by.items():
        pieces.sort()
        assert pieces[0][1] == 0 and pieces[-1][2] == len(want[k])
        for n, (no, s, e, p) in enumerate(pieces):
            assert no == n and p == want[k][s:e] and len(p) // 4 <= 50
            assert not n or 1 <= pieces[n - 1][2] - s <= 40
    assert splitting.split_oversized(items.limit(0), 50, 10).count() == 0


def test_split_covers_pieces_that_advance_little(spark):
    paragraph = ("x" * 118 + ". ") * 25 + "y" * 98  # 3,098 characters and a blank line: each piece ends after one paragraph
    text = "\n\n".join([paragraph] * 35)
    items = spark.createDataFrame([("s", "i", text)], "item_kind string, item_id string, content string")
    got = sorted((r.piece_no, r.start_offset, r.end_offset) for r in splitting.split_oversized(items).collect())
    assert got[0][1] == 0 and got[-1][2] == len(text) and len(got) > 32
    assert all(1 <= a[2] - b[1] <= 800 for a, b in zip(got, got[1:]))
    with pytest.raises(ValueError):
        splitting.split_oversized(items, 50, 30)


def test_split_overlaps_at_every_joint(spark):
    texts = {"sentences": ("y" * 214 + ". ") * 30, "unbroken": "x" * 9000, "long words": ("z" * 700 + " ") * 12, "none": "漢" * 5000}
    items = spark.createDataFrame([("s", k, t) for k, t in texts.items()], "item_kind string, item_id string, content string")
    for overlap in (15, 0):
        pieces = splitting.split_oversized(items, 200, overlap)
        for r in splitting.coverage(pieces, 200, overlap).collect():
            assert (r.chars_covered, r.sizes_ok, r.overlaps_ok) == (len(texts[r.item_id]), True, True)
        got = {}
        for r in pieces.collect():
            assert r.piece == texts[r.item_id][r.start_offset : r.end_offset]
            got.setdefault(r.item_id, []).append((r.start_offset, r.end_offset))
        assert set(got) == set(texts)
        for v in got.values():
            v.sort()
            assert all((1 <= a[1] - b[0] <= 60) if overlap else a[1] == b[0] for a, b in zip(v, v[1:]))


def test_tree_loses_no_pair():
    rng = np.random.default_rng(3)
    token = rng.integers(0, 90, 700)
    n = rng.integers(10, 60, 700)
    rest = np.minimum(n, rng.integers(5, 60, 700))
    tree = neardup.SignatureTree(token, n, rest)
    found = {(min(a, b), max(a, b)) for x, y in tree.pairs(0.6) for a, b in zip(x.tolist(), y.tolist())}
    real = {(i, j) for i in range(700) for j in range(i + 1, 700) if token[i] == token[j] and min(rest[i], rest[j]) * 1.6 >= 0.6 * (n[i] + n[j]) - 1e-9}
    assert real and found == real
    assert tree.kept[1] < 0.5 * tree.tested[1] and tree.tested[0] < 700 * 699 / 2


@pytest.mark.parametrize("tree_rows, hot", [(50, 4), (60_000, 20_000)])
def test_near_duplicates_equal_brute_force(spark, tree_rows, hot):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for i in range(12):
        base = [rng.choice(words) for _ in range(rng.randint(20, 70))]
        for j in range(6):
            edit = list(base)
            for _ in range(rng.randint(0, 7)):
                edit[rng.randrange(len(edit))] = rng.choice(words)
            rows.append((i % 2, f"r{i}_{j}", " ".join(edit)))
    sets = [(k, i, {tuple(t.split()[x : x + 3]) for x in range(len(t.split()) - 2)}) for k, i, t in rows]
    want = {(a[0], a[1], b[1]) for a in sets for b in sets if a[0] == b[0] and a[1] < b[1] and len(a[2] & b[2]) >= 0.6 * len(a[2] | b[2])}
    found = neardup.NearDuplicates(spark.createDataFrame(rows, "kind int, id string, text string"), tree_rows=tree_rows, hot_group=hot)
    assert want and {tuple(r) for r in found.pairs().collect()} == want
    root = {(k, i): i for k, i, _ in rows}
    for _ in rows:
        for k, a, b in want:
            root[k, a] = root[k, b] = min(root[k, a], root[k, b])
    size = {}
    for (k, _), r in root.items():
        size[k, r] = size.get((k, r), 0) + 1
    assert {tuple(r) for r in found.groups().collect()} == {(k, i, r, size[k, r]) for (k, i), r in root.items() if size[k, r] > 1}


def test_near_duplicates_edges(spark):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(3000)]
    base = [rng.choice(words) for _ in range(80)]
    edit = base[:40] + ["NEW"] + base[41:]
    rows = [(0, "a", " ".join(base)), (0, "b", " ".join(edit)), (0, "c", " ".join(base)), (1, "a", " ".join(base)), (0, "d", " ".join(rng.choice(words) for _ in range(80))), (0, "e", "too short"), (0, "f", None), (0, None, "x"), (0, "a", " ".join(base))]
    texts = spark.createDataFrame(rows, "kind int, id string, text string")
    assert {tuple(r) for r in neardup.NearDuplicates(texts).pairs().collect()} == {(0, "a", "b"), (0, "a", "c"), (0, "b", "c")}
    assert {tuple(r) for r in neardup.NearDuplicates(texts).pairs(expand=1).collect()} >= {(0, "a", "c"), (0, "a", "b")}
    assert {tuple(r) for r in neardup.NearDuplicates(texts).groups().collect()} == {(0, i, "a", 3) for i in "abc"}
    assert neardup.NearDuplicates(texts.limit(0)).pairs().count() == 0


def test_similar_against_brute_force(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 8))
    x[1::4] = x[::4] + rng.normal(size=x[::4].shape) * 0.1
    rows = [(f"v{i:03d}", [float(c) for c in v]) for i, v in enumerate(x)]
    rows += rows[:3] + [("z0", [0.0] * 8), ("z1", None), ("z2", [1.0]), ("z3", [float("nan")] * 8), (None, rows[0][1]), ("v900", rows[7][1])]
    df = spark.createDataFrame(rows, "id string, v array<double>")
    got = {(r.id, r.other_id) for r in similar.most_similar(df, 3, 0.9, dim=8, probes=12).collect()}
    ids = [r[0] for r in rows[:400]] + ["v900"]
    u = np.vstack([x, x[7:8]])
    u /= np.linalg.norm(u, axis=1)[:, None]
    s = u @ u.T
    np.fill_diagonal(s, -2)
    want = {(ids[i], ids[j]) for i in range(len(ids)) for j in np.argsort(-s[i])[:3] if s[i, j] >= 0.9}
    assert len(got & want) >= 0.9 * len(want) and got <= want
    assert ("v007", "v900") in got
    assert similar.most_similar(df.limit(0), dim=8).count() == 0


def test_similar_widens_where_cells_split_the_neighbours(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(3000, 16))
    x[:1000] = x[0] + rng.normal(size=(1000, 16)) * 0.1  # a third are near copies of one vector
    df = spark.createDataFrame([(f"v{i:04d}", [float(c) for c in v]) for i, v in enumerate(x)], "id string, v array<double>")
    u = x / np.linalg.norm(x, axis=1)[:, None]
    s = u @ u.T
    np.fill_diagonal(s, -2)
    got = {(int(r.id[1:]), int(r.other_id[1:])) for r in similar.most_similar(df, dim=16).collect()}
    want = {(i, int(j)) for i in range(len(u)) for j in np.argsort(-s[i])[:5]}
    assert len(got & want) >= 0.9 * len(want)


def test_best_fit_never_overfills():
    rng = random.Random(6)
    p = packing.BestFit(100, 4)
    load = {}
    for size in [0, 100, 250] + [rng.randint(1, 99) for _ in range(500)]:
        pieces = p.add(size)
        assert sum(n for _, _, n in pieces) == size and (size > 100) == (len(pieces) > 1)
        for b, _, n in pieces:
            load[b] = load.get(b, 0) + n
        assert p.open <= 4
    assert max(load.values()) <= 100


def test_pack_documents(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g h"), (2, ""), (3, None), (1, "a b c d e f g h")], "doc_id long, text string")
    budgets = spark.createDataFrame([("t", 5)], "budget_name string, capacity_tokens int")
    rows = packing.pack_documents(docs, budgets).collect()
    assert sum(r.tokens for r in rows) == 16 and {r.doc_id for r in rows} == {1, 2}
    with pytest.raises(ValueError):
        packing.pack_documents(docs, spark.createDataFrame([("t", 0)], "budget_name string, capacity_tokens int"))


def test_budget_fits_exactly():
    rng = random.Random(7)
    for _ in range(50):
        counts = {rng.randint(1, 60): rng.randint(1, 9) for _ in range(12)}
        budget = rng.randint(1, sum(n * c for n, c in counts.items()))
        taken = mixing.fit_budget(counts, budget)
        got = sum(n * c for n, c in taken.items())
        assert got <= budget and all(c <= counts[n] for n, c in taken.items()) and budget - got < min(counts) + 1
    assert mixing.fit_budget({3: 2}, 0) == {} and mixing.fit_budget({}, 5) == {}


def test_mix_shares_and_caps(spark):
    docs = spark.createDataFrame([(i, "A " if i < 60 else "b", "w " * (1 + i % 7)) for i in range(80)] + [(900, None, "x"), (901, "c", None), (0, "A ", "w")], "doc_id long, source string, text string")
    targets = spark.createDataFrame([("a", 0.5, 1), ("B", 0.3, 3), ("empty", 0.2, 2)], "source string, target_share double, max_repeats int")
    mix = mixing.SourceMix(docs, targets)
    used = mix.selection().collect()
    assert max(r.uses for r in used if r.source == "a") == 1 and max(r.uses for r in used if r.source == "b") <= 3
    report = {r.source: r for r in mix.report().collect()}
    assert report["empty"].actual_share == 0 and abs(report["a"].actual_share - 0.625) < 0.02
    assert mixing.SourceMix(docs.limit(0), targets).report().count() == 3


def _reader(known, **links):
    one = np.ones(4, np.float32)
    model = scans.Model({w: i for i, w in enumerate(known)}, np.tile(one, (len(known), 1)), np.zeros(4, np.float32), np.eye(4, dtype=np.float32))
    return scans.Reader(model, {k: [(v, one.tobytes() if v not in ("cut", "compound") else None)] for k, v in links.items()})


def test_scan_noise():
    words = "the department keeps entry under register coming fortnight committee explains reminder between quarterly".split()
    r = _reader(words, **{"nurnber": "number", "1ate": "late", "qua\x00rterly": "cut"})
    text = "The department keeps con-\ntainer entry nurnber 5 under the qua\nPage 3 of 9\nrterly register and 1ate pre-\nand post-entry text.\n\n12\n15\n19"
    noise, fixes, cuts = r.inspect(text, "Some title")
    assert set(noise) == {(0, "hyphen"), (1, "misread"), (1, "hyphen"), (2, "furniture"), (3, "misread")}
    assert "container entry number 5 under the quarterly register and late" in r.repair(text, "Some title")
    assert r.inspect("", None)[0] == [] and r.repair("", None) == ""
    unsure = scans.Reader(scans.Model(r.model.words, r.model.contexts * 0, r.model.mean, r.model.spread), r.facts)
    assert not unsure.inspect(text, "Some title")[1]  # without vectors nothing is corrected
    away = scans.Reader(scans.Model(r.model.words, -r.model.contexts, r.model.mean, r.model.spread), r.facts)
    assert not away.inspect(text, "Some title")[1]


def test_furniture_by_place_and_repetition():
    body = "The committee of the northern region has considered the request and the"
    lines = ["K12/34 | some memo", body, "2", body, "K12/34 | some memo", "following items were added to the list.", "Short heading", "", "Another paragraph stands here and is complete.", "A | B"]
    assert scans.furniture(lines, None) == {0, 2, 4} - ({0} if not scans._breaks(lines, 0) else set())
    assert scans.furniture(lines, "Short heading") >= {6}
    assert scans.furniture(lines, None, {"\x01W#/# | w w": [("furniture", None)]}) == {0, 2, 4}
    assert scans.furniture(["1", "2", "3"], None) == set() and scans.furniture([], None) == set()
    assert scans.masked("K12/34 | some mem0") == "W#/# | w w"


def _scan_corpus():
    rng = random.Random(4)
    shop = "shop head wear wool felt brim black cap coat scarf".split()
    cave = "cave night wing dark roost fly cavern echo sleep moth".split()
    desk = "list entry file page order desk clerk form sheet index".split()

    def say(words, target):
        w = rng.sample(words, 6)
        return " ".join(w[:3] + [target] + w[3:])

    rows = [say(shop, "hat") for _ in range(400)] + [say(desk, "number") for _ in range(400)] + [say(cave, "moth") for _ in range(300)]
    rows += [say(cave, "bat") for _ in range(7)] + [say(desk, "nurnber") for _ in range(4)] + [say(desk, "num6er") for _ in range(2)] + ["", None]
    return [(i, t, None) for i, t in enumerate(rows)]


def test_scan_vectors_decide(spark):
    docs = spark.createDataFrame(_scan_corpus(), "doc_id long, raw_markdown string, title string")
    got = {(r.doc_id, r.kind) for r in scans.noisy_lines(docs).collect()}
    misread = {i for i, k in got if k == "misread"}
    assert misread >= set(range(1107, 1111)) and not misread & set(range(1107))  # a rare right word beside a frequent one stays
    assert {(r.doc_id, r.kind) for r in scans.noisy_lines(docs, limit=0).collect()} == got  # facts by a join
    fixed = {r.doc_id: r.text for r in scans.repaired(docs.where("doc_id >= 1100")).collect()}
    assert fixed[1113] == "" and 1114 not in fixed
    assert scans.noisy_lines(docs.limit(0)).count() == 0


def test_subjects(spark):
    rng = random.Random(8)
    vocabulary = {"law": "court judge clause verdict appeal statute notary motion".split(), "sport": "goal match league coach pitch referee striker trophy".split()}

    def text(*names, chatter=0):
        s = [" ".join(rng.sample(vocabulary[n], 4)) + " today." for n in names]
        return " ".join(s + ["the room was quiet again today."] * chatter)

    docs = [(i, text(*[("law", "sport")[i % 2]] * 5)) for i in range(60)] + [(100, text(*["law"] * 5, *["sport"] * 4)), (101, text("sport", chatter=9)), (102, ""), (103, None)]
    d = spark.createDataFrame([(i, t, None, None, None, "x") for i, t in docs], "doc_id long, text string, title string, source string, source_path string, name string")
    areas = spark.createDataFrame([("law", ""), ("sport", "")], "subject string, description string")
    labels = spark.createDataFrame([(i, (" Law", "sport")[i % 2]) for i in range(24)] + [(1, "nonsense"), (3, None)], "doc_id long, subject string")
    got = {}
    for r in subjects.subject_posteriors(d, areas, labels).collect():
        got.setdefault(r.doc_id, set()).add(r.subject)
    assert all(got[i] == {("law", "sport")[i % 2]} for i in range(60))
    assert got[100] == {"law", "sport"} and 101 not in got and 102 not in got and 103 not in got
    assert subjects.subject_posteriors(d, areas, labels.limit(0)).count() == 0


def _patterns(rng, accuracy, n=4000, labelled=200):
    """Counts of (subject, pattern, label) of two-level functions that answer rightly with these probabilities."""
    out = {}
    for i in range(n):
        true = rng.random() < 0.4
        code = 0
        for p in accuracy:
            code = code * 2 + int(true if rng.random() < p else not true)
        key = 0, code, (1 if true else -1) if i < labelled else 0
        out[key] = out.get(key, 0) + 1
    return out


def test_accuracies_are_learned_and_every_function_counts():
    sizes = {"a": 2, "b": 2, "c": 2}
    post = subjects.learn_accuracies(_patterns(random.Random(1), (0.6, 0.9, 0.85)), functions=sizes)
    assert post[0, 0b011] > 0.9 and post[0, 0b100] < 0.5  # the accurate functions overrule the first
    for j, p in enumerate((0.3, 0.1, 0.15)):
        bit = 4 >> j
        moved = [abs(post[0, c | bit] - post[0, c & ~bit]) for c in range(8)]
        assert max(moved) > 0.05
    turned = subjects.learn_accuracies(_patterns(random.Random(1), (0.1, 0.9, 0.85)), functions=sizes)
    assert turned[0, 0b011] > turned[0, 0b111]  # a function that is mostly wrong counts against


def test_labels_steer_but_do_not_vote(spark):
    docs = [(i, ("court judge clause verdict. judge verdict court. ", "goal match league coach. match coach goal. ")[i % 2] * 3, None, ("x", "y")[i % 2], None, None) for i in range(80)]
    d = spark.createDataFrame(docs, "doc_id long, text string, title string, source string, source_path string, name string")
    areas = spark.createDataFrame([("law",), ("sport",)], "subject string")
    labels = spark.createDataFrame([(i, ("law", "sport")[i % 2 if i > 3 else 1 - i % 2]) for i in range(40)], "doc_id long, subject string")
    got = {(r.doc_id, r.subject) for r in subjects.subject_posteriors(d, areas, labels).collect()}
    assert got == {(i, ("law", "sport")[i % 2]) for i in range(80)}  # wrong labels included


def test_subject_tokens():
    assert subjects.tokens("") == [subjects.PARAGRAPH]
    t = subjects.tokens("One two. Three\n\nfour")
    marks = [x for x in t if x <= subjects.PARAGRAPH]
    assert marks == [subjects.SENTENCE, subjects.PARAGRAPH, subjects.PARAGRAPH] and len(t) == 7
