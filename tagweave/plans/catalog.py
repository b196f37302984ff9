"""Registered queries: one per operator, each (spark, sf_dir) -> DataFrame.

Every query reads the driver's tables through the adapters, runs over the
whole tables and returns scalar columns (lists joined with '|') so results
compare by value with the SQL twins in ``oracle``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import DEMO_ABSTRACT_RULES, DEMO_TITLE_RULES, LABELS_LONG, TEST_SHARE
from ..functions import tags as TG
from ..functions import text as TX
from ..functions.scores import sigmoid
from ..operators import combine as CB
from ..operators import dedup as DD
from ..operators import labels as LB
from ..operators import metrics as MT
from ..operators import neardup as ND
from ..operators import ranking as RK
from ..operators import setjoin as SJ
from ..operators import split as SP
from ..sources import adapters as AD
from ..sources import readers as RD
from ..sources.publish import publish, read_published
from ..session import ensure_checkpoint_dir, read_table, table_path

DEMO_FUNDER = "src3"
RULES = {"AwardTitle": DEMO_TITLE_RULES, "AwardAbstract": DEMO_ABSTRACT_RULES}
DEMO_PREFIXES = ["the ", "and "]  # abstract prefixes for the filter's own query; the rule list has none
DOWNSAMPLE_TARGET = ["4.2"]
DOWNSAMPLE_N = 10


def _j(c) -> F.Column:
    return F.array_join(c, "|")


def _r(c, n: int = 9) -> F.Column:
    return F.round(c, n)


# ---------------------------------------------------------------- text

def q_clean_ws(spark, sf):
    d = read_table(spark, sf, "documents", ["doc_id", "text"])
    return d.select("doc_id", TX.collapse_ws("text").alias("text_ws"))


def q_clean_boilerplate(spark, sf):
    r = AD.records(spark, sf)
    return r.select("doc_id", *[TX.strip_boilerplate(c, rules["boiler_plate"]).alias(c) for c, rules in RULES.items()])


def q_clean_lstrip(spark, sf):
    r = AD.records(spark, sf)
    return r.select("doc_id", *[TX.lstrip_punct(TX.strip_boilerplate(c, rules["boiler_plate"])).alias(c)
                                for c, rules in RULES.items()])


def q_clean_drop_phrases(spark, sf):
    r = AD.records(spark, sf)
    for c, rules in RULES.items():
        r = r.filter(TX.not_in_list(c, rules["drop"]))
    return r.select("doc_id", *RULES)


def q_clean_null_phrases(spark, sf):
    r = AD.records(spark, sf)
    return r.select("doc_id", *[TX.blank_listed(c, rules["nulls"]).alias(c) for c, rules in RULES.items()])


def q_clean_prefix_filter(spark, sf):
    r = AD.records(spark, sf)
    return r.filter(TX.no_listed_prefix("AwardTitle", DEMO_TITLE_RULES["prefixes"])
                    & TX.no_listed_prefix("AwardAbstract", DEMO_PREFIXES)).select("doc_id")


def q_clean_text_column(spark, sf):
    r = AD.records(spark, sf)
    for c, rules in RULES.items():
        r = TX.clean_text_column(r, c, rules)
    return r.select("doc_id", *RULES)


def _processed(spark, sf) -> DataFrame:
    return TX.process_texts(AD.records(spark, sf), title_rules=DEMO_TITLE_RULES,
                            abstract_rules=DEMO_ABSTRACT_RULES)


def q_process_texts(spark, sf):
    return _processed(spark, sf).select("doc_id", "AllText")


def q_split_text_lower(spark, sf):
    return TX.lower_text(_processed(spark, sf)).select("doc_id", F.col("AllText").alias("text"))


def q_dedup_exact(spark, sf):
    return DD.dedup_exact(_processed(spark, sf), "AllText", ["doc_id"]).select("doc_id", "AllText")


def q_source_counts(spark, sf):
    """Flagship: clean -> minimum length -> exact dedup -> documents per source."""
    d = DD.dedup_exact(_processed(spark, sf), "AllText", ["doc_id"])
    return (d.groupBy("FundingOrganisation")
             .agg(F.count(F.lit(1)).alias("n_docs"), F.sum(F.length("AllText")).alias("n_chars")))


# ---------------------------------------------------------------- sources

YEARS = (2014, 2018, 2022)


def _survey(spark, sf) -> DataFrame:
    years = [RD.read_survey_year(AD.survey_sheet(spark, sf, y), y) for y in YEARS]
    return RD.combine_survey_years(years)


def _second(spark, sf) -> DataFrame:
    return RD.read_second_source(AD.second_source_raw(spark, sf))


def q_src_survey_year(spark, sf):
    """Each sheet as read (its own tag columns, joined here to one string), percentages gone."""
    parts = []
    for y in YEARS:
        s = RD.read_survey_year(AD.survey_sheet(spark, sf, y), y)
        joined = [F.concat_ws("|", *RD.tag_columns(s.columns, m)).alias(m[:2]) for m in ("RA_", "HC_")]
        parts.append(s.select("FundingOrganisation", "OrganisationReference", "AwardTitle", "AwardAbstract",
                              *joined, "sheet_row", "year"))
    return RD.union_years(parts)


def q_survey_combined(spark, sf):
    s = _survey(spark, sf)
    return s.select("FundingOrganisation", "OrganisationReference", "AwardTitle", "AwardAbstract",
                    _j("RA").alias("RA"), _j("RA_top").alias("RA_top"), _j("HC").alias("HC"),
                    "src_year", "src_row")


def q_latest_per_key(spark, sf):
    """W1 alone: newest year per (funder, reference) over the three sheets."""
    years = [RD.read_survey_year(AD.survey_sheet(spark, sf, y), y) for y in YEARS]
    latest = DD.latest_per_key(RD.union_years(years), ["FundingOrganisation", "OrganisationReference"],
                               ["year", "sheet_row"])
    return latest.select("FundingOrganisation", "OrganisationReference", "year", "sheet_row")


def q_src_second(spark, sf):
    s = _second(spark, sf)
    return s.select("OrganisationReference", "AwardTitle", "AwardAbstract",
                    _j("RA").alias("RA"), _j("RA_top").alias("RA_top"), _j("HC").alias("HC"))


def q_drop_out_of_scope(spark, sf):
    raw = AD.second_source_raw(spark, sf)
    return raw.filter(TG.in_scope("ukcrc_value_rac")).select("project_id")


def q_null_placeholder_tags(spark, sf):
    raw = AD.second_source_raw(spark, sf)
    return raw.select("project_id", TG.null_placeholders("ukcrc_value", apply=True).alias("HC"))


def q_semi_join_refs(spark, sf):
    k = CB.semi_join_refs(_survey(spark, sf), _second(spark, sf), funder=DEMO_FUNDER)
    return k.select("OrganisationReference", "AwardTitle")


def _combined(spark, sf) -> DataFrame:
    return CB.combine_sources(_survey(spark, sf), _second(spark, sf), funder=DEMO_FUNDER)


def q_combine_sources(spark, sf):
    c = _combined(spark, sf)
    return c.select("FundingOrganisation", "OrganisationReference", "src_rank", "src_year", "src_row",
                    _j("RA").alias("RA"))


def q_pre_clean(spark, sf):
    p = CB.pre_clean(_combined(spark, sf))
    return p.select("index", "FundingOrganisation", "OrganisationReference")


def build_clean(spark, sf, near_dup: bool = True, pre_clean: DataFrame | None = None) -> DataFrame:
    """The whole build step: combine -> pre_clean -> clean texts -> dedup -> HC rename."""
    p = pre_clean if pre_clean is not None else CB.pre_clean(_combined(spark, sf))
    t = TX.process_texts(p, title_rules=DEMO_TITLE_RULES, abstract_rules=DEMO_ABSTRACT_RULES)
    if near_dup:
        t = ND.dedup_full(t, "index", "AllText", ("index",))
    else:
        t = DD.dedup_exact(t, "AllText", ["index"])
    return t.withColumn("HC", TG.normalise_tags("HC"))


def new_path(spark, name: str) -> str:
    """A fresh path in the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def write_build(spark, sf, path: str) -> None:
    """S3: ``pre_clean`` and ``clean`` written below a new path (an existing one is an error)."""
    CB.pre_clean(_combined(spark, sf)).write.mode("error").parquet(f"{path}/pre_clean")
    p = spark.read.parquet(f"{path}/pre_clean")
    build_clean(spark, sf, pre_clean=p).write.mode("error").parquet(f"{path}/clean")


def q_build_clean(spark, sf):
    """S3: the build step, written and read back."""
    path = new_path(spark, "build")
    write_build(spark, sf, path)
    b = spark.read.parquet(f"{path}/clean")
    return b.select("index", "FundingOrganisation", "AllText", _j("RA").alias("RA"),
                    _j("HC").alias("HC"))


# ---------------------------------------------------------------- tag lists

def q_tag_split_first_token(spark, sf):
    raw = AD.second_source_raw(spark, sf)
    return raw.select("project_id", _j(TG.first_tokens_slash("ukcrc_value_rac")).alias("ra"))


def q_tag_split_first_char(spark, sf):
    raw = AD.second_source_raw(spark, sf)
    return raw.select("project_id", _j(TG.top_chars_from_slash("hrcs_rac_category")).alias("ra_top"))


def q_tag_normalise(spark, sf):
    raw = AD.second_source_raw(spark, sf)
    return raw.select("project_id", _j(TG.normalise_tags(TG.split_commas("ukcrc_value"))).alias("hc"))


def q_wide_to_list(spark, sf):
    parts = []
    for sh in (AD.survey_sheet(spark, sf, y) for y in YEARS):
        ra, hc = (RD.tag_columns(sh.columns, m) for m in ("RA_", "HC_"))
        parts.append(sh.select("sheet_row", _j(TG.wide_to_list(ra)).alias("ra"), _j(TG.wide_to_list(hc)).alias("hc")))
    return RD.union_years(parts)


def q_tag_truncate(spark, sf):
    parts = []
    for y in YEARS:
        sh = AD.survey_sheet(spark, sf, y)
        ra = RD.tag_columns(sh.columns, "RA_")
        numeric = set(ra) if y == YEARS[0] else None
        parts.append(sh.select("sheet_row", _j(TG.truncate_codes(TG.wide_to_list(ra, numeric))).alias("ra")))
    return RD.union_years(parts)


def q_tag_top_level(spark, sf):
    lt = AD.line_tags(spark, sf)
    return lt.select("row_id", _j(TG.top_level("codes")).alias("ra_top"))


def q_label_parent(spark, sf):
    labels = AD.tag_long(spark, sf).select("label").distinct()
    p = TG.label_parent("label")
    return labels.select("label", p.alias("parent"), TG.super_group(p).alias("super_parent"))


def q_dim_labels(spark, sf):
    labels = AD.tag_long(spark, sf).select("label").distinct()
    dim = RD.label_dimension(spark)  # fixed 48 rows: a proven size bound
    j = labels.join(F.broadcast(dim), labels.label == dim.code, "left")
    return j.select("label", "label_idx", "name", "parent_name", "super_parent_name")


# ---------------------------------------------------------------- label statistics

def q_tag_dist_code(spark, sf):
    return LB.long_distribution(AD.tag_long(spark, sf), "label")


def q_tag_dist_top(spark, sf):
    lt = AD.line_tags(spark, sf).select(TG.top_level("codes").alias("RA_top"))
    return LB.tag_distribution(lt, "RA_top")


def q_tag_dist_cat(spark, sf):
    lt = AD.line_tags(spark, sf).select(TG.normalise_tags("hcs").alias("HC"))
    return LB.tag_distribution(lt, "HC")


def _split(spark, sf) -> tuple[DataFrame, DataFrame]:
    lt = AD.line_tags(spark, sf)
    return lt, SP.split_rarest(lt, "codes", "row_id")


def q_label_counts(spark, sf):
    lt, s = _split(spark, sf)
    long = LB.to_long(lt.select("row_id", F.array_distinct("codes").alias("codes")), "codes")
    long = long.join(s, "row_id")
    classes = long.select("label").distinct()
    return LB.label_counts(long, classes)


def q_class_weights(spark, sf):
    w = LB.class_weights(AD.tag_long(spark, sf))
    return w.select("label", "count", _r("weight").alias("weight"))


def q_binarise_labels(spark, sf):
    lt = AD.line_tags(spark, sf)
    classes = LB.class_list(lt, "codes")
    return LB.binarise(lt, "codes", classes, keep=["row_id"])


def q_sparse_indicators(spark, sf):
    """C14 by an index table: the places of each row's labels among the sorted classes."""
    lt = AD.line_tags(spark, sf)
    s = LB.sparse_indicators(lt, "codes", LB.label_index(lt, "codes"))
    return s.select("row_id", "n_classes", _j("indices").alias("indices"))


def q_downsample_tag(spark, sf):
    """The table is published, read, down-sampled and published over itself, and read back."""
    path = new_path(spark, "downsampled")
    publish(AD.line_tags(spark, sf).select("row_id", "codes"), path)
    publish(LB.downsample(read_published(spark, path), "codes", DOWNSAMPLE_TARGET, DOWNSAMPLE_N, seed=2), path)
    return read_published(spark, path).select("row_id")


def _tagged_scores(spark, sf) -> DataFrame:
    return RK.rank_threshold_tags(AD.scores_wide(spark, sf), "scores", "tags")


def q_tags_per_row_hist(spark, sf):
    return LB.tags_per_row_histogram(_tagged_scores(spark, sf), "tags")


# ---------------------------------------------------------------- scores and thresholds

def q_sigmoid_scores(spark, sf):
    w = AD.scores_wide(spark, sf)
    x = w.select("row_id", F.posexplode("logits").alias("label_idx", "logit"))
    return x.select("row_id", "label_idx", _r(sigmoid("logit"), 6).alias("score"))


def q_rank_scores(spark, sf):
    r = RK.rank_long(AD.scores_wide(spark, sf, tie_round=1))
    return r.select("row_id", "label_idx", "rank", _r("score", 6).alias("score"))


def q_rank_threshold_tags(spark, sf):
    t = _tagged_scores(spark, sf)
    return t.select("row_id", _j("tags").alias("tags"), F.size("tags").alias("n_tags"))


def q_flat_threshold_tags(spark, sf):
    t = RK.flat_threshold_tags(AD.scores_wide(spark, sf), "scores", "tags")
    return t.select("row_id", _j("tags").alias("tags"))


def q_infer_tags(spark, sf):
    t = RK.infer_tags(AD.scores_wide(spark, sf), LABELS_LONG)
    return t.select("row_id", _j("label").alias("labels"),
                    _r(F.aggregate("score", F.lit(0.0), lambda a, x: a + x), 6).alias("score_sum"))


# ---------------------------------------------------------------- metrics

def _eval_inputs(spark, sf):
    return AD.truth_long(spark, sf), AD.pred_long(spark, sf), AD.eval_meta(spark, sf)


def q_metrics_per_label(spark, sf):
    t, p, m = _eval_inputs(spark, sf)
    per = MT.with_names(MT.per_label(t, p, m))
    return per.select("scope", "level", "key", "tp", "fp", "fn", "support",
                      _r("precision").alias("precision"), _r("recall").alias("recall"),
                      _r("f1").alias("f1"), "name")


def _summary_cols(df: DataFrame) -> DataFrame:
    return df.select("prefix", *[_r(c).alias(c) for c in (
        "precision_macro", "precision_micro", "recall_macro", "recall_micro", "f1_macro", "f1_micro")],
        "label0_true", "label0_pred")


def q_metrics_summary(spark, sf):
    t, p, _ = _eval_inputs(spark, sf)
    s = MT.metric_suite(t, p).filter(F.col("level") == "detail")
    return _summary_cols(s)


def q_metrics_suite(spark, sf):
    t, p, m = _eval_inputs(spark, sf)
    return _summary_cols(MT.metric_suite(t, p, m))


def q_rollup_parent(spark, sf):
    t, p, _ = _eval_inputs(spark, sf)
    r = MT.rolled_up(t, p, levels=("parent",))
    return r.select("row_id", F.col("key").alias("parent"), "t", "p")


def q_rollup_super(spark, sf):
    t, p, _ = _eval_inputs(spark, sf)
    r = MT.rolled_up(t, p, levels=("super",))
    return r.select("row_id", F.col("key").alias("super_parent"), "t", "p")


def q_metrics_subgroup(spark, sf):
    t, p, m = _eval_inputs(spark, sf)
    return MT.subgroup_status(t, p, m)


def eval_truth(spark, sf) -> DataFrame:
    """True labels of the score rows: ``label`` and, when the 49th embedding
    value (not used for the scores) is positive, ``label + 10``."""
    e = read_table(spark, sf, "embeddings", ["vec_id", "label", "embedding"])
    second = F.when(F.element_at("embedding", 49) > 0, F.col("label") + 10)
    idx = F.array_compact(F.array(F.col("label"), second))
    codes = F.array(*[F.lit(n.split(":")[0]) for n in LABELS_LONG])
    return e.select(F.col("vec_id").alias("row_id"), F.explode(idx).alias("i")).select(
        "row_id", F.element_at(codes, F.col("i") + 1).alias("label"))


CODES = [n.split(":")[0] for n in LABELS_LONG]


def q_evaluate(spark, sf):
    """M8: rank thresholds, all levels, with the subgroup."""
    return _summary_cols(MT.evaluate(AD.scores_wide(spark, sf), eval_truth(spark, sf), CODES,
                                     meta=AD.eval_meta(spark, sf)))


def q_evaluate_flat(spark, sf):
    """M8 with rank weighting off: one threshold for all labels, no metadata."""
    return _summary_cols(MT.evaluate(AD.scores_wide(spark, sf), eval_truth(spark, sf), CODES, rank_weighting=False))


# ---------------------------------------------------------------- split

def q_split_rarest(spark, sf):
    _, s = _split(spark, sf)
    return s


def q_split_iterative(spark, sf):
    """M1 by label sets (rows-only check: the rounds depend on each other)."""
    lt = AD.line_tags(spark, sf)
    return SP.split_iterative(lt, "codes", "row_id")


def q_split_iterative_balance(spark, sf):
    """Whether each label's test rows are within one point, or one row, of the asked share."""
    lt = AD.line_tags(spark, sf)
    b = SP.split_balance(lt, "codes", SP.split_iterative(lt, "codes", "row_id"))
    off = F.abs(F.col("n_test") - TEST_SHARE * F.col("n"))
    return b.select("label", "n", (off <= F.greatest(F.lit(1.0), 0.01 * F.col("n"))).alias("balanced"))


def q_split_balance(spark, sf):
    lt, s = _split(spark, sf)
    b = SP.split_balance(lt, "codes", s)
    return b.select("label", "n", "n_test", _r("test_share").alias("test_share"))


def q_split_meta(spark, sf):
    lt = AD.line_tags(spark, sf).join(AD.eval_meta(spark, sf), "row_id")
    s = SP.split_with_meta(lt, "codes", ["FundingOrganisation"])
    return s.select("row_id", "split", "FundingOrganisation")


def q_split_categories(spark, sf):
    lt = AD.line_tags(spark, sf)
    d = _processed(spark, sf)
    base = (d.join(lt, d.doc_id == lt.row_id)
             .select("row_id", "FundingOrganisation", "AllText",
                     F.col("codes").alias("RA"), TG.top_level("codes").alias("RA_top"),
                     TG.normalise_tags("hcs").alias("HC")))
    s = SP.split_categories(base, ["RA", "RA_top", "HC"])
    return s.select("category", "split", "row_id", "FundingOrganisation", "text", _j("labels").alias("labels"))


def q_split_write(spark, sf):
    """The three-category split written once, partitioned by (category, split), read back."""
    out = new_path(spark, "splits")
    SP.write_splits(q_split_categories(spark, sf), out)
    back = spark.read.parquet(out)
    return back.select("category", "split", "row_id", "FundingOrganisation", "text", "labels")


def q_split_export(spark, sf):
    """Indicator columns of the sorted classes, lower-cased text last; written by split and read back."""
    d, lt = _processed(spark, sf), AD.line_tags(spark, sf)
    rows = d.join(lt, d.doc_id == lt.row_id).select("row_id", "FundingOrganisation", "codes",
                                                    F.lower("AllText").alias("AllText"))
    out = new_path(spark, "export")
    SP.write_export(rows, "codes", out, "AllText", ["FundingOrganisation"])
    meta = spark.read.parquet(f"{out}/meta")
    return spark.read.parquet(f"{out}/data").join(meta, "row_id")


# ---------------------------------------------------------------- near duplicates

def _distinct_texts(spark, sf) -> DataFrame:
    d = read_table(spark, sf, "documents", ["doc_id", "text"])
    return DD.dedup_exact(d, "text", ["doc_id"])


def q_minhash_signature(spark, sf):
    """Every minimum of every distinct text's signature."""
    s = ND.signatures(_distinct_texts(spark, sf), "doc_id", "text")
    return s.select(F.col("id").alias("doc_id"), F.size("sig").alias("n_minima"),
                    F.array_min("sig").alias("min_hash"), _j(F.col("sig").cast("array<string>")).alias("signature"))


def q_near_dup_pairs(spark, sf):
    """Exact, by prefix filtering."""
    p = SJ.similar_pairs(_distinct_texts(spark, sf), "doc_id", "text")
    return p.select("a", "b", _r("jaccard").alias("jaccard"))


def q_near_dup_keep(spark, sf):
    return ND.near_dup_keep(_distinct_texts(spark, sf), "doc_id", "text").select("doc_id")


def q_dedup_full(spark, sf):
    d = read_table(spark, sf, "documents", ["doc_id", "text"])
    return ND.dedup_full(d, "doc_id", "text", ("doc_id",)).select("doc_id")


# ---------------------------------------------------------------- scoring, tagger, stream

def q_score_batch(spark, sf):
    """M6 + M5: score every document with the stand-in model, tag by rank thresholds."""
    from ..streaming.scoring import hashed_linear_scorer
    from ..streaming.stream import tag_frame
    d = read_table(spark, sf, "documents", ["doc_id", "text"])
    t = tag_frame(d, hashed_linear_scorer())
    return t.select("doc_id", _j("labels").alias("labels"), F.size("labels").alias("n_tags"))


def q_fit_tagger(spark, sf):
    """M7: fit on the labelled documents, score and tag all documents (rows-only check)."""
    from ..streaming.tagger import fit_tagger
    df = AD.two_label(spark, sf)
    labels = ["quality", "toxic"]
    model = fit_tagger(df, "text", "tags", labels, num_features=1 << 14, max_iter=10)
    scored = model.transform(read_table(spark, sf, "documents", ["doc_id", "text"]).fillna("", "text"), "text", "doc_id")
    tagged = RK.rank_threshold_tags(scored, "scores", "tags", thresholds=[0.5, 0.5])
    return tagged.select("doc_id", _j(F.transform("tags", lambda i: F.element_at(
        F.array(*[F.lit(x) for x in labels]), i + 1))).alias("tags"))


def _trained(spark, sf):
    """M7: the joint tagger fitted on the labelled documents, saved and loaded again."""
    from ..streaming.joint import JointModel, fit_joint
    df = AD.two_label(spark, sf)
    model = fit_joint(df, "text", "tags", ["quality", "toxic"], "doc_id", dim=1 << 11, max_passes=25)
    return df, JointModel.load(spark, model.save(spark, new_path(spark, "model"), "v1"))


def q_score_trained(spark, sf):
    """M6/M7: all documents scored and tagged with a trained model that was saved and loaded (rows-only check)."""
    from ..streaming.stream import tag_frame
    _, model = _trained(spark, sf)
    t = tag_frame(read_table(spark, sf, "documents", ["doc_id", "text"]), model.scorer(spark), names=model.labels)
    return t.select("doc_id", _j("labels").alias("labels"), F.size("labels").alias("n_tags"))


def q_tagger_held_out(spark, sf):
    """M7: held-out support, precision, recall and F1 of the trained model, per label (rows-only check)."""
    from ..streaming.joint import held_out_scores
    df, model = _trained(spark, sf)
    return held_out_scores(df, model, "text", "tags", "doc_id")


def q_stream_tag(spark, sf):
    """The tagging stream over the documents table (one file or a folder of part files), run to completion."""
    from ..streaming.scoring import hashed_linear_scorer
    from ..streaming.stream import read_sink, run_stream
    sink = new_path(spark, "stream-tag")
    source = table_path(sf, "documents")
    schema = spark.read.parquet(source).schema
    # a pattern for this one name: a file stream lists a folder below it, and takes a plain file too
    run_stream(spark, f"{source[:-1]}[{source[-1]}]", schema, sink, hashed_linear_scorer())
    t = read_sink(spark, sink)
    return t.select("doc_id", _j("labels").alias("labels"), F.size("labels").alias("n_tags"))


QUERIES = {
    name[2:]: fn for name, fn in sorted(globals().items())
    if name.startswith("q_") and callable(fn)
}
