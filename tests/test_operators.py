"""Operator invariants and trap cases."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from tagweave.functions import tags as TG
from tagweave.operators import labels as LB
from tagweave.operators import metrics as MT
from tagweave.operators import neardup as ND
from tagweave.operators import ranking as RK
from tagweave.operators.dedup import dedup_exact
from tagweave.operators.split import split_iterative, split_rarest
from tagweave.sources.readers import label_names, read_second_source

from .conftest import SF001


def test_second_source_traps(spark):
    rows = [
        ("p1", "t", "a", "Cancer, mental", "1 Basic / 2 Aet", "9.1 Out/2.1 In"),
        ("p2", "t", "a", "oral", "None/3 Prev", "2.2 x/9.2 later"),
        ("p3", "t", "a", None, "4 Det", " 4.1 a / 4.2 b /"),
        ("p4", "t", "a", "x", None, "1.1 a"),
        ("p5", "t", "a", "x", "5 Dev", None),
        ("p6", "t", "a", "x", "", ""),
    ]
    raw = spark.createDataFrame(rows, "project_id string, project_title string, scientific_abstract string, "
                                      "ukcrc_value string, hrcs_rac_category string, ukcrc_value_rac string")
    out = {r["OrganisationReference"]: r for r in read_second_source(raw).collect()}
    assert "p1" not in out                     # first token 9.1 -> out of scope
    assert out["p2"]["RA"] == ["2.2", "9.2"]   # 9.2 as a later code is kept
    assert out["p2"]["RA_top"] == ["3"]        # literal None skipped
    assert out["p3"]["RA"] == ["4.1", "4.2"]   # spaces round '/', empty part dropped
    assert out["p3"]["HC"] is None
    assert "p4" not in out and "p5" not in out  # null in either activity column
    assert out["p6"]["RA"] == [] and out["p6"]["RA_top"] == [""]  # empty text has no first token: kept


def test_tag_list_functions(spark):
    df = spark.createDataFrame([([" Cancer ", "CARDIO", "Stroke"],), (None,)], "t array<string>")
    got = [r[0] for r in df.select(TG.normalise_tags("t")).collect()]
    assert got == [["cancer and neoplasms", "cardiovascular", "stroke"], None]
    df = spark.createDataFrame([(2.1, float("nan"), None, 3.0)], "a double, b double, c double, d double")
    got = df.select(TG.truncate_codes(TG.wide_to_list(["a", "b", "c", "d"], {"a", "b", "c", "d"}))).first()[0]
    assert got == ["2.1", "3.0"]
    df = spark.createDataFrame([(["2.1", " 3.4", "2.2", " "],)], "t array<string>")
    assert df.select(TG.truncate_codes("t")).first()[0] == ["2.1", " 3.", "2.2"]
    assert df.select(TG.top_level(TG.truncate_codes("t"))).first()[0] == [" ", "2"]
    df = spark.createDataFrame([("1.1: x",), ("x.y",), (None,)], "c string")
    assert [r[0] for r in df.select(TG.label_parent("c")).collect()] == [1, 0, 0]


def test_label_names_unknown_type():
    assert len(label_names("long")) == 48 and len(label_names("short")) == 8
    with pytest.raises(ValueError):
        label_names("huge")


def test_winners_by_packed_and_plain_order(spark):
    import random
    from tagweave.operators.dedup import latest_per_key
    rng = random.Random(5)
    longs = [None, -2**63, -1, 0, 1, 2**63 - 1]
    rows = [(rng.choice([None, "a", "b", "c"]), rng.choice([None, -2**31, 0, 2022, 2**31 - 1]), rng.choice(longs), rng.choice(longs), i)
            for i in range(400)]
    df = spark.createDataFrame(rows, "k string, y int, r long, z long, at int").repartition(7)
    for order in (["y", "r"], ["y", "z", "r"]):      # one decimal; too wide for one: a struct
        places = {"y": 1, "r": 2, "z": 3}

        def rank(row):
            return tuple((row[places[c]] is not None, row[places[c]] or 0) for c in order)
        best = {}
        for row in rows:
            best[row[0]] = max(best.get(row[0], rank(row)), rank(row))
        got = latest_per_key(df, ["k"], order)
        found = {r["k"]: rank(tuple(r[c] for c in ("k", "y", "r", "z"))) for r in got.collect()}
        assert got.count() == len(best) and found == best       # ties leave one row
    assert latest_per_key(df.filter("false"), ["k"], ["y"]).count() == 0


def test_winners_are_found_by_a_hash_aggregate(spark):
    from tagweave.operators.dedup import _order, winning_places
    rows = spark.range(30).selectExpr("id", "cast(id % 7 as int) y", "id % 3 k", "id __at", "repeat('text', 9) t")
    last = winning_places(rows, [F.md5(F.col("k").cast("string"))], _order(rows, ["y", "id"]))
    plan = last._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "SortAggregate" not in plan and "ObjectHashAggregate" not in plan
    assert "SortAggregate" not in dedup_exact(rows, "t", ["id"])._jdf.queryExecution().executedPlan().toString()
    assert {r["__at"] for r in last.collect()} == {20, 27, 13}


def test_dedup_exact_last_wins_and_idempotent(spark):
    df = spark.createDataFrame([(1, "Hello World"), (2, "hello world"), (3, "Other"), (4, "HELLO world")],
                               "index long, AllText string")
    once = dedup_exact(df, "AllText", ["index"])
    assert sorted(r["index"] for r in once.collect()) == [3, 4]
    twice = dedup_exact(once, "AllText", ["index"])
    assert sorted(r["index"] for r in twice.collect()) == [3, 4]


def _sequential_walk(nodes, edges):
    nb = {n: set() for n in nodes}
    for a, b in edges:
        nb[a].add(b)
        nb[b].add(a)
    kept, dropped = set(), set()
    for n in sorted(nodes):
        if n not in dropped:
            kept.add(n)
            dropped |= nb[n]
    return kept


def test_greedy_survivors_equals_sequential_walk(spark):
    rnd = random.Random(3)
    for trial in range(4):
        nodes = list(range(1, 40))
        edges = {tuple(sorted(rnd.sample(nodes, 2))) for _ in range(50)}
        nd = spark.createDataFrame([(n,) for n in nodes], "id long")
        ed = spark.createDataFrame(list(edges), "a long, b long")
        got = {r["id"] for r in ND.greedy_survivors(nd, ed).collect()}
        assert got == _sequential_walk(nodes, edges), trial


def test_chain_is_not_components(spark):
    # A~B, B~C, A!~C: the walk keeps A and C, components would keep one.
    nd = spark.createDataFrame([(1,), (2,), (3,)], "id long")
    ed = spark.createDataFrame([(1, 2), (2, 3)], "a long, b long")
    assert {r["id"] for r in ND.greedy_survivors(nd, ed).collect()} == {1, 3}


def test_near_dup_pairs_match_exact_jaccard(spark):
    base = "the quick brown fox jumps over the lazy dog near the river bank today "
    texts = [base * 3, base * 3 + "x", base * 2 + "completely different words here and there", "short",
             "another text entirely unrelated to the rest of them all", base * 3 + "yz"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    got = {(r["a"], r["b"]) for r in ND.near_dup_pairs(df, "id", "text").collect()}

    def sh(t):
        t = t.lower()
        return {t[i:i + 9] for i in range(len(t) - 8)} or {t}
    want = {(i, j) for i, j in itertools.combinations(range(len(texts)), 2)
            if len(sh(texts[i]) & sh(texts[j])) / len(sh(texts[i]) | sh(texts[j])) >= 0.6}
    assert got == want


def test_hot_bucket_survivors_equal_sequential_walk(spark):
    # Clusters of near-copies plus unrelated texts; hot_bucket=2 forces every
    # shared bucket through the star path, the default through exact edges.
    rnd = random.Random(7)
    words = [f"w{i}" for i in range(400)]
    texts = []
    for c in range(4):
        base = [rnd.choice(words) for _ in range(60)]
        for v in range(5):
            t = list(base)
            for _ in range(v * 2):
                t[rnd.randrange(len(t))] = rnd.choice(words)
            texts.append(" ".join(t))
    texts += [" ".join(rnd.choice(words) for _ in range(60)) for _ in range(5)]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    pairs = [(r["a"], r["b"]) for r in ND.near_dup_pairs(df, "id", "text").collect()]
    want = _sequential_walk(list(range(len(texts))), pairs)
    for hot in (2, 512):
        got = {r["id"] for r in ND.near_dup_keep(df, "id", "text", hot_bucket=hot).collect()}
        assert got == want, hot
    assert len(want) < len(texts)


def test_boilerplate_bucket_is_settled_in_few_rounds(spark, monkeypatch):
    # Texts that share a long header but are no near-copies, and a cluster of near-copies among them.
    rnd = random.Random(11)
    words = [f"w{i}" for i in range(3000)]
    header = " ".join(rnd.choice(words) for _ in range(60))
    texts = [header + " " + " ".join(rnd.choice(words) for _ in range(60)) for _ in range(250)]
    copied = texts[100]
    texts[101:250:3] = [f"{copied} x{i}" for i in range(len(texts[101:250:3]))]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    sets = [set(ND._char_shingles(t, 9).tolist()) for t in texts]
    pairs = [(i, k) for i, k in itertools.combinations(range(len(texts)), 2)
             if len(sets[i] & sets[k]) >= 0.6 * len(sets[i] | sets[k])]
    want = _sequential_walk(list(range(len(texts))), pairs)
    rounds = []
    real = ND.cut_lineage
    monkeypatch.setattr(ND, "cut_lineage", lambda d: rounds.append(1) or real(d))
    got = {r["id"] for r in ND.near_dup_keep(df, "id", "text").collect()}
    assert got == want and 150 < len(want) < 250
    assert len(rounds) < 60  # about five tables a round


def test_prefix_filter_keeps_nulls(spark):
    from tagweave.functions.text import no_listed_prefix
    df = spark.createDataFrame([(1, "The end"), (2, None), (3, "end")], "id long, t string")
    assert {r["id"] for r in df.filter(no_listed_prefix("t", ["the "])).collect()} == {2, 3}


def test_evaluate_subgroup_by_status(spark):
    from tagweave.operators.metrics import evaluate
    scores = spark.createDataFrame([(1, [0.9, 0.1]), (2, [0.2, 0.6])], "row_id long, scores array<double>")
    truth = spark.createDataFrame([(1, "1.1"), (2, "1.2")], "row_id long, label string")
    meta = "row_id long, FundingOrganisation string"

    def prefixes(m):
        return {r["prefix"] for r in evaluate(scores, truth, ["1.1", "1.2"], rank_weighting=False, meta=m).collect()}
    plain = {"", "parent_", "super_parent_"}
    assert prefixes(None) == plain
    assert prefixes(spark.createDataFrame([(1, "a"), (2, "b")], meta)) == plain  # no_subgroup_rows
    assert prefixes(spark.createDataFrame([(1, "Wellcome Trust")], meta)) == plain  # unmatched_rows
    assert len(prefixes(spark.createDataFrame([(1, "Wellcome Trust"), (2, "b")], meta))) == 6  # computed


def test_star_jaccard_equals_pairwise(spark):
    texts = ["alpha beta gamma delta epsilon zeta eta theta", "alpha beta gamma delta epsilon zeta eta iota",
             "completely unrelated words in this one", "alpha beta gamma"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    star = spark.createDataFrame([(0, 1), (0, 2), (0, 3)], "a long, b long")
    got = {(r["a"], r["b"]): r["jaccard"] for r in ND.star_jaccard(star, df, "id", "text").collect()}
    want = {(r["a"], r["b"]): r["jaccard"] for r in ND.exact_jaccard(star, df, "id", "text").collect()
            if r["jaccard"] > 0}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in got)


def test_blocked_buckets_give_every_pair_once(spark):
    # 30 texts in one bucket with block=4 -> 8 blocks, 36 cells; all 435 pairs, once each.
    sig = spark.createDataFrame([(i, [7] * 6) for i in range(30)], "id long, sig array<long>")
    pairs = ND.candidate_pairs(sig, n_bands=2, band_rows=3, block=4)
    got = [(r["a"], r["b"]) for r in pairs.collect()]
    assert len(got) == len(set(got)) == 30 * 29 // 2


def test_rank_thresholds_ties_and_edges(spark):
    # rank 1: 0.9 > 0.2; rank 2: exactly 0.5 (fails '>' but passes '>='); rank 5: saturated 1.0.
    scores = [0.9, 0.5, 0.1, 0.05, 1.0]
    df = spark.createDataFrame([(1, scores)], "row_id long, scores array<double>")
    strict = RK.rank_threshold_tags(df, thresholds=[0.95, 0.2, 0.5, 0.8]).first()["tags"]
    assert strict == [0, 4]  # ranks: 1.0(idx4) 0.9(idx0) 0.5(idx1)
    df2 = spark.createDataFrame([(1, [0.5, 0.1, 0.05, 0.01, 0.9])], "row_id long, scores array<double>")
    ev = RK.rank_threshold_tags(df2, thresholds=[0.2, 0.5, 0.8, 0.95]).first()["tags"]
    inf = RK.rank_threshold_tags(df2, thresholds=[0.2, 0.5, 0.8, 0.95], inclusive=True).first()["tags"]
    assert ev == [4] and inf == [0, 4]
    ties = spark.createDataFrame([(1, [0.7, 0.7, 0.7])], "row_id long, scores array<double>")
    ranks = {r["label_idx"]: r["rank"] for r in RK.rank_long(ties).collect()}
    assert ranks == {2: 1, 1: 2, 0: 3}  # ties: higher label index first
    # A saturated score after rank 4 passes only in the inclusive form.
    sat = spark.createDataFrame([(1, [1.0] * 6)], "row_id long, scores array<double>")
    assert len(RK.rank_threshold_tags(sat, inclusive=True).first()["tags"]) == 6
    assert len(RK.rank_threshold_tags(sat).first()["tags"]) == 4
    assert len(RK.rank_threshold_tags(sat, inclusive=True, beyond="never").first()["tags"]) == 4


def _brute_metrics(truth, pred, classes):
    out = {}
    for c in classes:
        tp = sum(1 for r in truth if c in truth[r] and c in pred.get(r, set()))
        fp = sum(1 for r in pred if c in pred[r] and c not in truth.get(r, set()))
        fn = sum(1 for r in truth if c in truth[r] and c not in pred.get(r, set()))
        out[c] = (tp, fp, fn)
    return out


def test_metrics_match_brute_force(spark):
    rnd = random.Random(5)
    classes = ["1.1", "1.2", "2.1", "4.3", "7.2", "8.5"]
    truth = {r: set(rnd.sample(classes, rnd.randint(1, 3))) for r in range(60)}
    pred = {r: set(rnd.sample(classes, rnd.randint(0, 3))) for r in range(60)}
    t = spark.createDataFrame([(r, c) for r, cs in truth.items() for c in cs], "row_id long, label string")
    p = spark.createDataFrame([(r, c) for r, cs in pred.items() for c in cs], "row_id long, label string")
    per = {r["key"]: r for r in MT.per_label(t, p, scopes=("all",)).filter("level = 'detail'").collect()}
    bf = _brute_metrics(truth, pred, classes)
    for c in classes:
        assert (per[c]["tp"], per[c]["fp"], per[c]["fn"]) == bf[c]
    s = MT.summary(MT.per_label(t, p, scopes=("all",))).filter("level = 'detail'").first()
    TP, FP, FN = (sum(v[i] for v in bf.values()) for i in range(3))
    assert s["f1_micro"] == pytest.approx(2 * TP / (2 * TP + FP + FN))
    f1s = [2 * a / (2 * a + b + c) if (2 * a + b + c) else 0.0 for a, b, c in bf.values()]
    assert s["f1_macro"] == pytest.approx(sum(f1s) / len(f1s))
    # OR roll-up is monotone: a parent is positive iff some child is.
    par = MT.rolled_up(t, p, levels=("parent",)).collect()
    for r in par:
        kids = {c for c in truth[r["row_id"]] if c.split(".")[0] == r["key"]}
        assert r["t"] == (1 if kids else 0)


def test_labels_outside_the_layout_are_counted(spark):
    """Unknown codes, parents above 8, null labels, repeated rows and class lists longer than a long."""
    t = spark.createDataFrame([(1, "1.1"), (1, "9.7"), (1, "9.7"), (2, "odd"), (3, None), (4, "1.99")], "row_id long, label string")
    p = spark.createDataFrame([(1, "9.7"), (2, "1.2"), (4, "1.98"), (5, "odd")], "row_id long, label string")
    got = {(r["level"], r["key"]): (r["tp"], r["fp"], r["fn"]) for r in MT.per_label(t, p, scopes=("all",)).collect()}
    assert {k[1]: v for k, v in got.items() if k[0] == "detail"} == {
        "1.1": (0, 0, 1), "9.7": (1, 0, 0), "odd": (0, 1, 1), "1.2": (0, 1, 0), "1.99": (0, 0, 1), "1.98": (0, 1, 0)}
    assert got[("parent", "1")] == (1, 1, 1) and ("parent", "9") not in got and len(got) == 6 + 8 + 3
    assert [(r["row_id"], r["t"], r["p"]) for r in MT.rolled_up(t, p, levels=("parent",)).filter("key = '9'").collect()] == [(1, 1, 1)]
    many = spark.createDataFrame([(f"c{i:03d}",) for i in range(200)], "key string")
    wide = spark.createDataFrame([(i, f"c{i:03d}") for i in range(150)], "row_id long, label string")
    got = MT.per_label(wide, wide.filter("row_id % 2 = 0"), classes=many, scopes=("all",)).filter("level = 'detail'")
    assert {r["key"]: (r["tp"], r["fp"], r["fn"]) for r in got.collect()} == {
        f"c{i:03d}": (int(i < 150 and i % 2 == 0), 0, int(i < 150 and i % 2 == 1)) for i in range(200)}


def test_metrics_scan_each_input_once(spark, tmp_path):
    t = spark.createDataFrame([(1, "1.1")], "row_id long, label string")
    t.write.parquet(f"{tmp_path}/t")
    spark.createDataFrame([(1, "Other")], "row_id long, FundingOrganisation string").write.parquet(f"{tmp_path}/m")
    t, m = spark.read.parquet(f"{tmp_path}/t"), spark.read.parquet(f"{tmp_path}/m")
    plan = MT.level_counts(t, t, m)._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("FileScan") == 3 and "Join" not in plan


def test_subgroup_with_no_rows(spark):
    t = spark.createDataFrame([(1, "1.1")], "row_id long, label string")
    meta = spark.createDataFrame([(1, "Other")], "row_id long, FundingOrganisation string")
    assert MT.subgroup_status(t, t, meta).first()["status"] == "no_subgroup_rows"
    assert MT.subgroup_status(t, t, None).first()["status"] == "meta_not_found"
    meta2 = spark.createDataFrame([(2, "Wellcome Trust")], "row_id long, FundingOrganisation string")
    assert MT.subgroup_status(t, t, meta2).first()["status"] == "unmatched_rows"


def test_split_is_a_partition_and_stable(spark):
    lt = spark.read.parquet(f"{SF001}/lineitem.parquet").groupBy(F.col("l_orderkey").alias("row_id")).agg(
        F.collect_set(F.concat((1 + F.col("l_partkey") % 8).cast("string"), F.lit("."),
                               (1 + F.col("l_suppkey") % 5).cast("string"))).alias("codes"))
    lt = lt.unionByName(spark.createDataFrame([(-1, []), (-2, None)], "row_id long, codes array<string>"))
    a = {r["row_id"]: r["split"] for r in split_rarest(lt, "codes").collect()}
    assert -2 not in a and a[-1] in ("train", "test")     # null dropped, [] kept
    assert len(a) == lt.count() - 1
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    try:
        b = {r["row_id"]: r["split"] for r in split_rarest(lt.repartition(5), "codes").collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert a == b
    share = sum(1 for v in a.values() if v == "test") / len(a)
    assert 0.18 < share < 0.22


def test_iterative_split_balances_every_label(spark):
    rnd = random.Random(11)
    labs = ["a", "b", "c", "d", "e"]
    rows = [(i, rnd.sample(labs, rnd.randint(1, 3))) for i in range(400)] + [(1000 + i, []) for i in range(10)]
    df = spark.createDataFrame(rows + [(-1, None)], "row_id long, codes array<string>")
    s = {r["row_id"]: r["split"] for r in split_iterative(df, "codes").collect()}
    assert len(s) == 410 and -1 not in s
    for lab in labs:
        ids = [i for i, ls in rows if lab in ls]
        share = sum(1 for i in ids if s[i] == "test") / len(ids)
        assert abs(share - 0.2) < 0.01, (lab, share)
    again = {r["row_id"]: r["split"] for r in split_iterative(df.repartition(3), "codes").collect()}
    assert again == s


def test_iterative_split_narrows_by_prefixes(spark, monkeypatch):
    from tagweave.operators import split as SP
    rnd = random.Random(3)
    labs = [f"{i}.{j}" for i in range(4) for j in range(3)]
    df = spark.createDataFrame([(i, rnd.sample(labs, rnd.randint(1, 5))) for i in range(500)], "row_id long, codes array<string>")
    whole = sorted(map(tuple, split_iterative(df, "codes").collect()))
    monkeypatch.setattr(SP, "KEYS_AT_ONCE", 2)
    assert sorted(map(tuple, split_iterative(df, "codes").collect())) == whole


def test_splits_refuse_an_unbounded_label_universe(spark, monkeypatch):
    from tagweave.operators import split as SP
    monkeypatch.setattr(SP, "MAX_LABELS", 2)
    df = spark.createDataFrame([(1, ["a", "b", None]), (2, ["c"])], "row_id long, codes array<string>")
    for split in (split_rarest, split_iterative):
        with pytest.raises(ValueError):
            split(df, "codes").collect()
    some = df.filter("row_id = 1")
    assert split_rarest(some, "codes").count() == split_iterative(some, "codes").count() == 1
    none = df.filter("row_id = 0")
    assert split_rarest(none, "codes").count() == split_iterative(none, "codes").count() == 0


def test_sparse_indicators_of_many_labels(spark):
    from tagweave.operators.labels import label_index, sparse_indicators
    lists = [["b", "a", "b"], [], None, ["c", None], ["a"], ["a"]]
    few = spark.createDataFrame([(1, x) for x in lists], "row_id long, tags array<string>")     # equal ids, one row each
    got = [(r["n_classes"], r["indices"]) for r in sparse_indicators(few, "tags", label_index(few, "tags")).collect()]
    assert sorted(map(str, got)) == sorted(map(str, [(3, x) for x in ([0, 1], [], None, [2], [0], [0])]))
    many = spark.range(50_000).selectExpr("id AS row_id", "array(format_string('l%05d', id), format_string('l%05d', (id * 7) % 50000)) AS tags")
    out = sparse_indicators(many, "tags", label_index(many, "tags"))
    bad = out.filter("indices <> array_sort(array_distinct(array(row_id, (row_id * 7) % 50000))) OR n_classes <> 50000")
    assert out.count() == 50_000 and bad.count() == 0


def test_downsample_exact_n(spark):
    df = spark.createDataFrame([(i, ["2.1"] if i % 3 else ["1.1", "2.1"]) for i in range(60)] + [(99, None)],
                               "row_id long, codes array<string>")
    out = LB.downsample(df, "codes", ["2.1"], 7)
    n_target = sum(1 for r in out.collect() if r["codes"] == ["2.1"])
    assert n_target == 7 and out.count() == 20 + 1 + 7
    assert LB.downsample(df, "codes", ["2.1"], 1000).count() == df.count()


def test_class_weights_total_is_assignments(spark):
    long = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a")], "row_id long, label string")
    w = {r["label"]: r["weight"] for r in LB.class_weights(long).collect()}
    assert w == {"a": 1.5, "b": 3.0}


def test_csv_sheet_reader_and_null_safe_semi_join(spark, tmp_path):
    from tagweave.operators.combine import semi_join_refs
    from tagweave.sources.readers import load, read_survey_year
    csv = tmp_path / "sheet2018.csv"
    csv.write_text("FundingOrganisation,OrganisationReference,AwardTitle,AwardAbstract,CodingType,"
                   "RA_1,RA_1%,HC_1,sheet_row\n"
                   "F1,R1,T1,A1,Manual,2.1,100,cancer,1\n"
                   "F1,R2,T2,A2,Automatic,3.1,100,oral,2\n"
                   "F2,,T3,A3,Manual,,,,3\n")
    schema = ("FundingOrganisation string, OrganisationReference string, AwardTitle string, "
              "AwardAbstract string, CodingType string, RA_1 string, `RA_1%` double, HC_1 string, sheet_row long")
    with pytest.raises(ValueError):
        load(spark, str(csv), "csv")
    sheet = read_survey_year(load(spark, str(csv), "csv", schema, header=True), 2018)
    assert sheet.columns == ["FundingOrganisation", "OrganisationReference", "AwardTitle", "AwardAbstract",
                             "RA_1", "HC_1", "sheet_row", "year"]
    assert sorted(r["sheet_row"] for r in sheet.collect()) == [1, 3]   # non-Manual row dropped
    second = spark.createDataFrame([("R1",), (None,), ("R9",)], "OrganisationReference string")
    plain = semi_join_refs(sheet, second, funder="F2")
    safe = semi_join_refs(sheet, second, funder="F2", null_safe=True)
    assert plain.count() == 0 and [r[0] for r in safe.collect()] == [None]


def test_opt_in_corrections(spark):
    from tagweave.functions.text import clean_text_column
    rules = {"drop": [], "nulls": [], "prefixes": [], "boiler_plate": ["aim", "aims"]}
    df = spark.createDataFrame([(0, "Aims: x"), (1, "Aiming high")], "row_no int, t string")
    parity = [r[0] for r in clean_text_column(df, "t", rules).orderBy("row_no").select("t").collect()]
    fixed = [r[0] for r in clean_text_column(df, "t", rules, word_boundary=True, longest_first=True)
             .orderBy("row_no").select("t").collect()]
    assert parity == ["s: x", "ing high"] and fixed == ["x", "Aiming high"]
    codes = spark.createDataFrame([([" 2.15", "3.4"],)], "t array<string>")
    assert codes.select(TG.truncate_codes("t")).first()[0] == [" 2.", "3.4"]
    assert codes.select(TG.truncate_codes("t", trim_first=True)).first()[0] == ["2.1", "3.4"]


def test_label_counts_zero_filled(spark):
    long = spark.createDataFrame([(1, "a", "train"), (2, "a", "test"), (3, "b", "train")],
                                 "row_id long, label string, split string")
    classes = spark.createDataFrame([("a",), ("b",), ("c",)], "label string")
    got = {(r["split"], r["label"]): r["count"] for r in LB.label_counts(long, classes).collect()}
    assert got == {("train", "a"): 1, ("test", "a"): 1, ("train", "b"): 1, ("test", "b"): 0,
                   ("train", "c"): 0, ("test", "c"): 0}


def test_minima_of_long_texts_by_runs():
    """The signature kernel by runs gives the minima over all distinct shingles, and holds no product of the whole batch."""
    import tracemalloc

    import numpy as np
    import pandas as pd
    rng = np.random.default_rng(3)
    a, b = ND._coefficients(126, 5)
    for n in (1, 9, ND.RUN + 8, 5 * ND.RUN + 17):
        text = "".join(chr(c) for c in rng.integers(97, 123, n))
        out = np.empty(126, dtype=np.uint64)
        ND._minima(ND._char_hashes(text, 9), a, b, out)
        with np.errstate(over="ignore"):
            want = (ND._char_shingles(text, 9)[:, None] * a + b).min(axis=0)
        assert (out == want).all()
    texts = ["".join(chr(c) for c in rng.integers(97, 123, 20_000)) for _ in range(100)]
    kernel = ND._minhash_udf(126, 5, "char", 9).func
    tracemalloc.start()
    sig = kernel(pd.Series(texts))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(sig) == 100 and peak < 16_000_000      # before: over 40 MB, growing with the batch


def test_small_buckets_read_texts_of_likely_pairs_only(spark, monkeypatch):
    """Texts that meet in a band by chance are dropped by their minima before any text is read."""
    rng = random.Random(8)
    words = [f"w{i}" for i in range(400)]
    shared = [" ".join(rng.sample(words, 30)) for _ in range(4)]
    texts = [rng.choice(shared) + " " + " ".join(rng.sample(words, 45)) for _ in range(60)]
    texts += [t[:-6] + "changed" for t in texts[:5]]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    read = []
    whole = ND.exact_jaccard
    monkeypatch.setattr(ND, "exact_jaccard", lambda pairs, *a, **k: read.append(pairs.count()) or whole(pairs, *a, **k))
    kept = {r["id"] for r in ND.near_dup_keep(df, "id", "t").collect()}
    met = ND.candidate_pairs(ND.signatures(df, "id", "t")).count()
    assert kept == set(range(60)) and 5 <= read[0] < met / 3


def test_categories_move_the_texts_once(spark):
    """One join for all categories, with the rows of a split and a join by category; ids may repeat and labels be null."""
    from tagweave.operators.split import split_categories
    data = [(i % 37, f"Text {i}", [f"a{i % 3}"], [f"b{i % 4}"] if i % 5 else None, "f") for i in range(40)] + [(None, "x", ["a1"], [], "f")]
    df = spark.createDataFrame(data, "row_id int, AllText string, RA array<string>, HC array<string>, FundingOrganisation string")
    got = split_categories(df, ["RA", "HC"])
    want = []
    for cat in ("RA", "HC"):
        s = split_rarest(df, cat, "row_id").select("row_id", "split")
        want += [(*r, cat.lower()) for r in df.select("row_id", F.lower("AllText"), cat, "FundingOrganisation").join(s, "row_id").collect()]
    key = lambda r: str(tuple(r))
    assert got.columns == ["row_id", "text", "labels", "FundingOrganisation", "split", "category"]
    assert sorted(map(key, got.collect())) == sorted(map(key, want))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("AllText") <= 3 and "Union" in plan      # before: the text column was scanned by every category


def test_iterative_rounds_scan_the_sets_once(spark, monkeypatch):
    """A round's choice reads the round's own sets, not the table of all sets."""
    from tagweave.operators import split as SP
    rng = random.Random(4)
    df = spark.createDataFrame([(i, rng.sample([f"l{j}" for j in range(9)], rng.randrange(4))) for i in range(300)], "row_id long, codes array<string>")
    read = []
    nth = SP._nth_key
    monkeypatch.setattr(SP, "_nth_key", lambda keys, *a: read.extend(keys.inputFiles()) or nth(keys, *a))
    rows = split_iterative(df, "codes", "row_id").collect()
    assert len(rows) == 300 and 60 <= sum(r["split"] == "test" for r in rows) <= 90
    assert read and all("/round=" in f for f in read)


def test_export_computes_its_input_once(spark, tmp_path):
    from tagweave.operators.split import write_export
    calls = spark.sparkContext.accumulator(0)

    def seen(t):
        calls.add(1)
        return t

    df = spark.createDataFrame([(i, [f"l{i % 3}"], f"text {i}", "f") for i in range(30)], "row_id long, codes array<string>, t string, m string")
    df = df.withColumn("t", F.udf(seen)("t")).filter(F.length("t") > 0)
    write_export(df, "codes", str(tmp_path / "out"), "t", ["m"])
    data = spark.read.parquet(str(tmp_path / "out" / "data"))
    assert data.count() == 30 and set(data.columns) == {"row_id", "l0", "l1", "l2", "text", "split"}
    assert calls.value <= 60      # once, or twice where the filter computes it again; before: 120 at least


def test_line_tags_shuffle_numbers_only(spark, tmp_path):
    """The texts of a line are made after the shuffle, in the order of line, part, supplier, quantity."""
    from tagweave.sources import adapters as AD
    rows = [(1, 5, 3, 2, 4.0, "N"), (1, 9, 1, 1, 2.0, "R"), (1, 4, 3, 2, 4.0, "N"), (1, None, 1, 3, 1.0, "N"), (None, 8, 5, 1, None, "N")]
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_returnflag string"
                          ).write.parquet(str(tmp_path / "lineitem.parquet"))
    t = AD.line_tags(spark, str(tmp_path))
    got = {r["row_id"]: r for r in t.collect()}
    assert got[1]["codes"] == ["2.2", "5.4", "6.4", None] and got[1]["codes9"] == ["1.2", "5.4", "6.4", None]
    assert got[1]["hcs"] == [AD.DEMO_HC_RAW[9], "Generic", "Renal", "Neurological"] and got[1]["qty"] == [2.0, 4.0, 4.0, 1.0]
    assert got[None]["codes"] == ["1.1"] and got[None]["qty"] == [None]
    grouped = t._jdf.queryExecution().optimizedPlan().toString()
    collected = grouped[grouped.index("Aggregate"):]
    below = collected[collected.index("Project"):]
    assert "concat" not in below and "element_at" not in below


def test_signature_query_returns_every_minimum(spark, tmp_path):
    """All 126 minima of every distinct text, against the maps applied to all its shingles."""
    import numpy as np

    from tagweave.plans.catalog import q_minhash_signature
    texts = ["Some text of a few words", "some TEXT of a few words", "short", "", "a" * 50 + "b", "another text " * 400]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    a, b = ND._coefficients(126, ND.MINHASH_SEED)
    want = {}
    for i, t in enumerate(texts[1:], 1):
        with np.errstate(over="ignore"):
            low = (ND._char_shingles(t.lower(), 9)[:, None] * a + b).min(axis=0).view(np.int64)
        want[i] = "|".join(map(str, low))
    got = {r["doc_id"]: r["signature"] for r in q_minhash_signature(spark, str(tmp_path)).collect()}
    assert got == want


def test_large_sets_are_signed_by_bins(spark, monkeypatch):
    """Equal minima follow the Jaccard; sets on both sides of the border meet in a band; the walk is the same with bins for
    all, for some and for no sets."""
    import numpy as np
    rng = np.random.default_rng(4)
    common = rng.integers(0, 1 << 63, 3000).astype(np.uint64)
    shares, bounds = [], ND._bin_bounds(126)
    for _ in range(60):
        x, y = (ND._bin_minima(ND._permuted(np.concatenate([common, rng.integers(0, 1 << 63, 1000).astype(np.uint64)]), s), bounds)
                for s in (5, 5))
        common = rng.integers(0, 1 << 63, 3000).astype(np.uint64)
        shares.append((x == y).mean())
    assert abs(np.mean(shares) - 0.6) < 0.02          # 3000 of 5000
    h = np.sort(rng.integers(0, 1 << 63, 700).astype(np.uint64))
    x = ND._permuted(h, 9)
    assert (ND._bin_minima(x, bounds) == [min((v for v in x.tolist() if v * 126 >> 64 == i), default=(1 << 64) - 1) for i in range(126)]).all()

    rnd = random.Random(21)
    texts = []
    for n in (60, 80, 90, 100, 120, 200, 400):
        base = [f"w{rnd.randrange(3000)}" for _ in range(n)]
        for v in range(5):
            t = list(base)
            for _ in range(v * n // 25):
                t[rnd.randrange(n)] = f"w{rnd.randrange(3000)}"
            texts.append(" ".join(t[:n - v * n // 20]))
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    sets = [set(ND._char_shingles(t, 9).tolist()) for t in texts]
    pairs = [(i, j) for i, j in itertools.combinations(range(len(texts)), 2)
             if len(sets[i] & sets[j]) >= 0.6 * len(sets[i] | sets[j])]
    want = _sequential_walk(list(range(len(texts))), pairs)
    for least in (0, 512, 10 ** 9):
        monkeypatch.setattr(ND, "BINS_FROM", least)
        assert {r["id"] for r in ND.near_dup_keep(df, "id", "t").collect()} == want, least
        sig = ND.bucket_signatures(df, "id", "t").select("id", "bins", F.explode("keys").alias("key"))
        met = {(r["a"], r["b"]) for r in sig.select(F.col("id").alias("a"), "key").join(
            sig.select(F.col("id").alias("b"), "key"), "key").filter("a < b").select("a", "b").distinct().collect()}
        assert set(pairs) <= met, least
    assert 15 < len(pairs) and len(want) < len(texts) and max(map(len, sets)) > 512 > min(map(len, sets))


def test_near_dup_keep_computes_its_input_once(spark):
    """The input is read for signatures, pairs, leaders and the result: it is written once, not computed for each."""
    from pyspark.sql.types import StringType
    seen = spark.sparkContext.accumulator(0)

    def count(t):
        seen.add(1)
        return t

    texts = [f"text {i % 20} " * 20 + f"end {i}" for i in range(60)]
    df = (spark.createDataFrame(list(enumerate(texts)), "id long, t string").repartition(4)
          .withColumn("t", F.udf(count, StringType()).asNondeterministic()("t")))
    kept = ND.near_dup_keep(df, "id", "t", hot_bucket=2).collect()
    assert len(kept) < 60 and seen.value == 60


def test_dedup_full_writes_its_rows_once_after_the_exact_step(spark, monkeypatch):
    """Exact copies go by the last id, then the walk; the rows between the steps are written once."""
    texts = ["A long enough text of words " * 3, "a long enough TEXT of words " * 3, "a long enough text of words " * 3 + "x", None, "", "other"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    wide = []
    real = ND.cut_lineage
    monkeypatch.setattr(ND, "cut_lineage", lambda d: wide.append("t" in d.columns) or real(d))
    got = {r["id"] for r in ND.dedup_full(df, "id", "t", ("id",)).collect()}
    assert got == {1, 3, 5} and sum(wide) == 1
