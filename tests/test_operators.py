import numpy as np
import pytest
from pyspark.sql import functions as F

from utterloom.operators import codec, endpoints, evaluation, rules, splits, warping
from utterloom.operators import corpus as co
from utterloom.operators import frames as fr
from utterloom.operators import matching as m

SCRIPT = """
(ASSUME ARE AM I YOU MY YOUR)
; a small script of our own
(GREETING GOOD DAY. WHAT IS ON YOUR MIND?)
(NONE (GO ON.) (TELL ME MORE.))
(SUB I YOU) (SUB YOU I) (SUB MY YOUR) (SUB AM ARE) (SUB MOM MOTHER)
(TAG MOTHER NOUN FAMILY) (TAG MOM FAMILY)
(MEMORY MY ((0 YOUR 0) EARLIER YOU SPOKE OF YOUR 3.))
(MY 2 ((0 YOUR 0 (/FAMILY) 0) (WHO ELSE IN YOUR FAMILY 5?) (YOUR 4?)) ((0 YOUR 0) (WHY YOUR 3?) (NEWKEY)))
(ARE ((0) (WHY ARE THEY?)))
(COMPUTER 50 ((0) (DO MACHINES WORRY YOU?)))
(MACHINE 50 = COMPUTER)
(AM ((0 ARE YOU 0) (PRE (I ARE 4) ARE)))
(SAD 1 ((0 (* SAD LOW) 0) (SORRY THAT YOU ARE 2.)))
"""


@pytest.fixture(scope="module")
def script():
    return rules.compile_script(SCRIPT)


def test_script_is_compiled(script):
    assert script.greeting == "GOOD DAY. WHAT IS ON YOUR MIND?" and script.rules["COMPUTER"].rank == 50 and script.rules["MACHINE"].goto == "COMPUTER"
    assert script.rules["MY"].parts[0][0] == (0, "YOUR", 0, "/FAMILY", 0)
    assert script.rules["SAD"].parts[0][1][0] == (rules.LITERAL, "SORRY THAT YOU ARE 2.")
    with pytest.raises(ValueError):
        rules.nested("(A (B)")
    with pytest.raises(ValueError):
        rules.nested("A)")


def slow_match(pattern, words, tags):
    if not pattern:
        return [] if not words else None
    e = pattern[0]
    counts = range(len(words) + 1) if e == 0 else [e] if isinstance(e, int) else [1]
    for n in counts:
        own = words[:n]
        fits = len(own) == n and (isinstance(e, int) or (own[0] in e if isinstance(e, tuple) else e[1:] in tags.get(own[0], ()) if e[0] == "/" else own[0] == e))
        if fits and (rest := slow_match(pattern[1:], words[n:], tags)) is not None:
            return [own, *rest]
    return None


def test_patterns_match_as_by_backtracking():
    rng, tags = np.random.default_rng(5), {"A": ("T",), "C": ("T", "U")}
    elements = [0, 0, 1, 2, "A", "B", ("A", "C"), "/T", "/U", "/V"]
    for _ in range(3000):
        pattern = tuple(elements[i] for i in rng.integers(0, len(elements), rng.integers(1, 5)))
        words = ["ABCD"[i] for i in rng.integers(0, 4, rng.integers(0, 6))]
        assert rules.match(pattern, words, tags) == slow_match(pattern, words, tags), (pattern, words)


def test_fill():
    assert rules.fill("WHY 1 2?", [["YOU", "TOLD", "I"], ["X"]]) == "WHY YOU TOLD ME X?"
    assert rules.fill("YOUR 3?", [["A"]]) == "YOUR?" and rules.fill("IS 1.", [["I"]]) == "IS I."
    assert rules.fill("? 1 !", [[]]) == "? !"


def test_conversation(script):
    d = rules.Doctor(script)
    assert d.respond("Well, my mom hates me, but no") == "WHO ELSE IN YOUR FAMILY HATES ME?"
    assert d.respond("My mother again") == "YOUR MOTHER?"
    assert d.respond("a machine and my dog") == "DO MACHINES WORRY YOU?"
    assert d.respond("I am sad") == "SORRY THAT YOU ARE SAD."
    assert d.respond("hm") == "EARLIER YOU SPOKE OF YOUR DOG."  # only the latest stays
    assert d.respond("hm") == "GO ON." and d.respond("hm") == "TELL ME MORE." and d.respond("hm") == "GO ON."


def test_bag(script):
    d = rules.Doctor(script)
    assert d.respond_to_bag(["mother"]) == "YOUR MOTHER?"
    assert d.respond_to_bag(["sad"]) == "SORRY THAT YOU ARE SAD."
    assert d.respond_to_bag(["zebra"]) == "GO ON."


def test_replies_in_order(spark, script):
    turns = spark.createDataFrame([(1, 1, "My mother again"), (1, 0, "My mom hates me"), (2, 0, None)], "conv_id long, turn long, text string")
    assert {(r.conv_id, r.turn): r.reply for r in rules.replies(turns, script).collect()} == {(1, 0): "WHO ELSE IN YOUR FAMILY HATES ME?", (1, 1): "YOUR MOTHER?", (2, 0): "GO ON."}


def test_reachable(spark, script):
    got = {r.reply for r in rules.reachable(spark, script, ["MACHINE", "AM"]).collect()}
    assert got == {"DO MACHINES WORRY YOU?", "WHY ARE THEY?"}


def slow_warp(q, t, band):
    n, k, cost = len(q), len(t), {}
    for i in range(n):
        for j in range(max(0, i * k // n - band), min(k - 1, i * k // n + band) + 1):
            d = int(np.abs(q[i] - t[j]).sum())
            ways = [2 * d] if i == j == 0 else [cost.get((i - 1, j), warping.FAR) + d, cost.get((i, j - 1), warping.FAR) + d, cost.get((i - 1, j - 1), warping.FAR) + 2 * d]
            cost[i, j] = min(ways)
    end = cost.get((n - 1, k - 1), warping.FAR)
    return warping.FAR if end >= warping.FAR else end // (n + k)


def test_warping(spark):
    rng = np.random.default_rng(2)
    for _ in range(60):
        q, t = (rng.integers(-50, 50, (rng.integers(1, 25), 3)) for _ in range(2))
        want = warping.FAR if len(q) > 2 * len(t) or len(t) > 2 * len(q) else slow_warp(q, t, 4)
        assert warping.distance(q, t, 4) == want
    x = rng.integers(-9, 9, (6, 2))
    got = warping.class_distances(spark.createDataFrame([(1, x.tolist())], "query int, frames array<array<int>>"), [("a", x), ("b", x + 5), ("a", x + 9)]).collect()
    assert {r.label: r.score for r in got}["a"] == 0


def test_codec_round_trip():
    rng = np.random.default_rng(3)
    x = (9000 * np.sin(np.arange(4001) * 0.07) + rng.integers(-400, 400, 4001)).astype(int)
    blob = codec.encode(x)
    assert len(blob) == codec.clip_length(len(x))
    y = codec.decode(blob)
    assert y[0] == x[0] and len(y) == len(x) and 10 * np.log10((x**2).sum() / ((x - y) ** 2).sum()) > 15
    body, at, out = blob[codec.HEAD.size :], 0, []
    value, index = y[0], 0
    for n in (2, 10, 4, 600, 3384):  # any chunks, even but for the last
        part, value, index = codec.decode_codes(body[at // 2 :], n, value, index)
        out += part
        at += n
    assert out == y[1:]
    for n in (0, 1, 2, 3):
        assert len(codec.decode(codec.encode(x[:n]))) == n
    assert codec.decode(codec.encode([-32768, 32767] * 40))[0] == -32768


def test_archive():
    clips = [("b" * 8, b"12345", 9), ("a" * 8, b"xyz", 5)]
    assert codec.open_archive(codec.pack_archive(clips)) == (16_000, sorted(clips))
    with pytest.raises(ValueError):
        codec.pack_archive([clips[0], clips[0]])


def test_evaluation_edges(spark):
    schema = "truth_kind string, truth_label int, best long, best_label int, second long"
    silent = spark.createDataFrame([("word", 1, 900, 1, 950), ("oov", None, None, None, None)], schema)
    r = evaluation.operating_point(silent, 100, 0).first()
    assert (r.precision, r.recall, r.n_words) == (1.0, 0.0, 1)
    empty = evaluation.operating_point(spark.createDataFrame([], schema), 100, 0).first()
    assert (empty.precision, empty.recall, empty.n_words, empty.tp) == (1.0, 0.0, 0, 0)
    rows = spark.createDataFrame([("variant", 1, 50, 1, None), ("variant", 1, 50, 2, None), ("word", 1, 100, 1, 139), ("word", 2, 100, 1, 140)], schema)
    r = evaluation.operating_point(rows, 100, 40).first()
    assert (r.tp, r.wrong, r.oov, r.benign) == (0, 1, 1, 1)


def test_gates(spark):
    df = spark.createDataFrame([([(10, "a"), (60, "b")],), ([(10, "a")],), ([],)], "r array<struct<score:int,label:string>>")
    assert [x.f for x in df.select(m.fires(F.col("r"), 10, 50).alias("f")).collect()] == ["a", "a", None]
    assert [x.f for x in df.select(m.fires(F.col("r"), 10, 51).alias("f")).collect()] == [None, "a", None]


def test_word_is_found(spark):
    rng = np.random.default_rng(7)
    x = rng.integers(-20, 20, 160 * 120)
    x[160 * 50 : 160 * 80] += (9000 * np.sin(np.arange(160 * 30) * 0.2)).astype(int)
    rows = spark.createDataFrame([("w", i, int(v)) for i, v in enumerate(x)] + [("s", i, 0) for i in range(160 * 40)], "key string, i long, x int")
    got = endpoints.endpoints(fr.frame_stats(rows, "key", 160), "key").collect()
    assert len(got) == 1 and abs(got[0].start - 160 * 47) <= 480 and abs(got[0].stop - 160 * 83) <= 480


def test_checks_find_faults(spark):
    good = spark.createDataFrame([("a", "train"), ("b", "test")], "voice string, split string")
    assert co.leaks(good, "voice").count() == 0
    assert [r.voice for r in co.leaks(good.unionByName(spark.createDataFrame([("a", "test")], "voice string, split string")), "voice").collect()] == ["a"]
    pairs = spark.createDataFrame([(2, 3), (5, 4), (3, 4)], "a long, b long")
    nodes = spark.range(1, 8).withColumnRenamed("id", "node")
    assert {r.node: r.family for r in co.families(pairs, nodes).collect()} == {1: 1, 2: 2, 3: 2, 4: 2, 5: 2, 6: 6, 7: 7}
    diff = co.result_diff(spark.createDataFrame([(1, 5), (2, 5), (3, None)], "k int, v int"), spark.createDataFrame([(2, 6), (3, None), (4, 1)], "k int, v int"), "k", "v")
    assert {r.k: r.state for r in diff.collect()} == {1: "missing", 2: "different", 3: "equal", 4: "extra"}


def test_splits(spark):
    got = splits.balanced({"a": 30, "b": 10, "c": 10, "d": 5, "e": 5})
    assert got["a"] == "train" and set(got.values()) == {"train", "val", "test"}
    rows = spark.createDataFrame([("a", i) for i in range(6)] + [("b", 1), ("b", 2), ("c", 1), ("c", 2)], "family string, n int")
    made = splits.with_splits(rows, "family", {"c": "test"})
    assert {(r.family, r.split) for r in made.collect()} == {("a", "train"), ("b", "val"), ("c", "test")} and co.leaks(made, "family").count() == 0
    v = spark.createDataFrame([("x", "train", "novelty"), ("y", "test", "novelty"), ("z", "val", "natural")], "voice string, split string, tier string")
    assert {r.split: r.ok for r in splits.requirements(v).collect()} == {"train": True, "test": False, "val": True}
    assert [splits.margin_verdict(10, b) for b in (20, 12, 9)] == ["usable", "marginal", "unusable"]


def test_unfinished_families_are_an_error(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)], "a long, b long")
    nodes = spark.createDataFrame([(i,) for i in range(41)], "node long")
    with pytest.raises(RuntimeError):
        co.families(edges, nodes, rounds=1)
    assert {r.family for r in co.families(edges, nodes).collect()} == {0}


def test_bag_reads_only_what_the_script_assumes(script):
    bare = rules.compile_script(SCRIPT.replace("(ASSUME ARE AM I YOU MY YOUR)", ""))
    assert rules.Doctor(bare).respond_to_bag(["mother"]) == bare.none[0]
    assert rules.Doctor(script).reading((0, "YOU", 0), ["SAD"]) == ([[], ["YOU"], []], False)


def test_reachable_through_a_long_chain(spark):
    n = 40
    long = rules.compile_script("".join(f"(K{i} ((0 K{i} 0) (GOTO K{i + 1})))" for i in range(n)) + f"(K{n} = K0 ((0 K{n} 0) (AT LAST.)))")
    assert [r.reply for r in rules.reachable(spark, long, ["K0"]).collect()] == ["AT LAST."]


def test_required_splits():
    voice = lambda family, gender, quality=0, locale="en_US", tier="natural": {"family": family, "gender": gender, "quality": quality, "locale": locale, "tier": tier}
    rows = [voice("a", "male"), voice("b", "male", 2), voice("c", "female"), voice("d", "female", 1), voice("e", "male"), voice("f", "unknown", 2), voice("n", "male", 2, tier="novelty")]
    rows += [voice(f"g{i}", g, locale="en_GB") for i, g in enumerate(("male", "female", "male", "unknown", "unknown", "unknown", "unknown", "unknown"))]
    got = {r["family"]: r["split"] for r in splits.required(rows)}
    assert {k for k, v in got.items() if v == "test"} >= {"b", "d"} and got["a"] == got["c"] == got["e"] == got["f"] == got["n"] == "train"
    assert got["g0"] == got["g1"] == "val" and set(got.values()) == {"train", "val", "test"}
    assert sum(got[f"g{i}"] == "train" for i in range(2, 8)) == 4
    assert splits.required([]) == []


def test_more_families_than_the_driver_plans_for(spark, monkeypatch):
    monkeypatch.setattr(splits, "FAMILIES", 3)
    with pytest.raises(ValueError):
        splits.with_splits(spark.createDataFrame([(str(i),) for i in range(4)], "family string"), "family")


def test_class_scores_against_all_pairs(spark):
    rng = np.random.default_rng(3)
    q, t = rng.integers(-50, 50, (40, 6)), rng.integers(-50, 50, (9, 6))
    rows = [(i, x.tolist(), int(n)) for i, (x, n) in enumerate(zip(q, rng.integers(1, 9, 40)))] + [(99, None, 1)]
    library = [(f"l{i % 3}", x.tolist(), int(k)) for i, (x, k) in enumerate(zip(t, rng.integers(1, 9, 9)))]
    left, right = spark.createDataFrame(rows, "query long, v array<int>, n int"), spark.createDataFrame(library, "label string, t array<int>, m int")
    for ratio in (None, 150):
        want = {}
        for i, x, n in rows[:-1]:
            for label, y, k in library:
                if ratio is None or (n * 100 <= k * ratio and k * 100 <= n * ratio):
                    want[i, label] = min(want.get((i, label), 1 << 30), int(np.abs(np.array(x) - y).sum()))
        assert {(r.query, r.label): r.score for r in m.class_scores(left, right, ratio).collect()} == want
    assert m.class_scores(left, right.limit(0)).count() == 0
