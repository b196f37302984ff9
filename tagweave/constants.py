"""Fixed values.

Everything in the first block below must equal the values of the original
tagging pipeline for results to match; they are data, listed plainly and in
their natural order.  The demo rule set further down is ours: it is tuned to
the synthetic ``documents`` prose so that every cleaning rule fires on the
driver tables.
"""

from __future__ import annotations

import string

# --------------------------------------------------------------------------
# FIXED VALUES (must equal the original pipeline's; do not edit)
# --------------------------------------------------------------------------

TITLE_RULES = {
    "drop": [
        "mrc studentship - award title not available in public dataset",
        "award title unavailable in public datasetredacted for public dataset",
        "no data entered",
    ],
    "prefixes": [
        "pivotal nurse support contract",
        "nihr in-practice fellowship",
        "nurture: national unified renal",
        "qi project: assist-ckd",
    ],
    "nulls": [
        "award title unavailable",
        "award title unavailable in public dataset",
        "no title available",
    ],
    "boiler_plate": [
        "wellcome trust clinical phd programme at the university of liverpool:",
        "cruk[d]?/[0-9]*/[0-9]*",
        "lsi doctoral training centres",
        "epsrc centre for doctoral training in",
        "nihr global health research group on",
        "cruck",
        "ams professorship award for",
        "cancer research uk",
        "cruk/ohsu",
        "wellcome trust",
    ],
}

ABSTRACT_RULES = {
    "drop": [
        "award abstract not available in public dataset",
        "award abstract unavailable in public dataset",
        "mrc studentship - award abstract not available in public dataset",
        "redacted for public dataset",
    ],
    "prefixes": [],
    "nulls": [
        "(pivotal) study",
        "abstract not available",
        "award abstract not available in public dataset",
        "award abstract unavailable for analysis or public dataset",
        "awardabstract",
        "no data entered",
        "cso nrs career research fellowship award - no abstract available",
        "nihr biomedical research centre (brc) award - no abstract available",
        "nihr biomedical research unit (bru) award - no abstract available",
        "nihr collaboration for leadership in applied health research and care (clahrc) award - no abstract available",
        "nihr healthcare technology cooperative (htc) - no abstract available",
        "nihr imperial patient safety translational research centre - no abstract available",
        "no abstract",
        "no abstract available for this analysis",
        "no abstract available for this analysis.",
        "no abstract available/provided",
        "no abstract available/provided or marked confidential",
        "no abstract provided for this analysis",
        "paper abstract only",
        "rare diseases translational research collaboration (trc) - no abstract available",
        "no abstract provided for this analysis",
    ],
    "boiler_plate": [
        "background",
        "aim",
        "aims",
        "background",
        "objectives",
        "objective",
        "mica",
        "what is the project about",
        "design",
        "description",
        "x000d_",
        "this work was supported by the francis crick institute which receives its core funding from the uk medical research council \\(fc001000\\), the Wellcome Trust \\(fc001000\\),and cancer research uk \\(fc001000\\)",
    ],
}

TEXT_RULES = {"title": TITLE_RULES, "abstract": ABSTRACT_RULES}

# Health-category rename map (key: trimmed lower-case name).
HC_RENAME = {
    "cancer": "cancer and neoplasms",
    "cardio": "cardiovascular",
    "congenital": "congenital disorders",
    "inflammatory": "inflammatory and immune system",
    "inflamation and immune": "inflammatory and immune system",
    "inflammatory and immune system": "inflammatory and immune system",
    "injuries": "injuries and accidents",
    "mental": "mental health",
    "metabolic": "metabolic and endocrine",
    "muscle": "musculoskeletal",
    "oral": "oral and gastrointestinal",
    "renal": "renal and urogenital",
    "reproduction": "reproductive health and childbirth",
    "generic": "generic health relevance",
    "other": "disputed aetiology and other",
}

# Research-activity label dictionaries; the label index is the list position.
LABELS_LONG = [
    "1.1: Normal biological development and functioning (underpinning)",
    "1.2: Psychological and socioeconomic processes (underpinning)",
    "1.3: Chemical and physical sciences (underpinning)",
    "1.4: Methodologies and measurements (underpinning)",
    "1.5: Resources and infrastructure (underpinning)",
    "2.1: Biological and endogenous factors (aetiology)",
    "2.2: Factors relating to physical environment (aetiology)",
    "2.3: Psychological, social and economic factors (aetiology)",
    "2.4: Surveillance and distribution (aetiology)",
    "2.5: Research design and methodologies (aetiology)",
    "2.6: Resources and infrastructure (aetiology)",
    "3.1: Primary prevention interventions to modify behaviours or promote well-being (prevention)",
    "3.2: Interventions to alter physical and biological environmental risks (prevention)",
    "3.3: Nutrition and chemoprevention (prevention)",
    "3.4: Vaccines (prevention)",
    "3.5: Resources and infrastructure (prevention)",
    "4.1: Discovery and preclinical testing of markers and technologies (detection)",
    "4.2: Evaluation of markers and technologies (detection)",
    "4.3: Influences and impact (detection)",
    "4.4: Population screening (detection)",
    "4.5: Resources and infrastructure (detection)",
    "5.1: Pharmaceuticals (development of treatments)",
    "5.2: Cellular and gene therapies (development of treatments)",
    "5.3: Medical devices (development of treatments)",
    "5.4: Surgery (development of treatments)",
    "5.5: Radiotherapy and other non-invasive therapies (development of treatments)",
    "5.6: Psychological and behavioural (development of treatments)",
    "5.7: Physical (development of treatments)",
    "5.8: Complementary (development of treatments)",
    "5.9: Resources and infrastructure (development of treatments)",
    "6.1: Pharmaceuticals (evaluation of treatments)",
    "6.2: Cellular and gene therapies (evaluation of treatments)",
    "6.3: Medical devices (evaluation of treatments)",
    "6.4: Surgery (evaluation of treatments)",
    "6.5: Radiotherapy and other non-invasive therapies (evaluation of treatments)",
    "6.6: Psychological and behavioural (evaluation of treatments)",
    "6.7: Physical (evaluation of treatments)",
    "6.8: Complementary (evaluation of treatments)",
    "6.9: Resources and infrastructure (evaluation of treatments)",
    "7.1: Individual care needs (disease management)",
    "7.2: End of life care (disease management)",
    "7.3: Management and decision making (disease management)",
    "7.4: Resources and infrastructure (disease management)",
    "8.1: Organisation and delivery of services (health services)",
    "8.2: Health and welfare economics (health services)",
    "8.3: Policy, ethics and research governance (health services)",
    "8.4: Research design and methodologies (health services)",
    "8.5: Resources and infrastructure (health services)",
]

LABELS_SHORT = [
    "1: Underpinning research",
    "2: Aetiology",
    "3: Prevention of disease and conditions",
    "4: Detection screening and diagnosis",
    "5: Development of treatments and therapeutic interventions",
    "6: Evaluation of treatments and therapeutic interventions",
    "7: Management of diseases and conditions",
    "8: Health social care services research",
]

LABELS_TINY = ["Basic Research", "Translational Research", "Applied Research"]

# Parent digit -> super group (1-3 basic, 4-5 translational, 6-8 applied).
SUPER_GROUPS = {1: 1, 2: 1, 3: 1, 4: 2, 5: 2, 6: 3, 7: 3, 8: 3}

# Rank thresholds: the score at rank r (0-based) must beat THRESHOLDS[r];
# every rank after the list uses 1.0.
RANK_THRESHOLDS = [0.2, 0.5, 0.8, 0.95]
BEYOND_THRESHOLD = 1.0
FLAT_THRESHOLD = 0.5

TEST_SHARE = 0.2
MIN_CHAR_LEN = 110
NEAR_DUP_JACCARD = 0.6
MINHASH_SEED = 7
SURVEY_YEARS = [2014, 2018, 2022]
SURVEY_2014_RENAMES = {
    "GrantCode_Public": "OrganisationReference",
    "Title_Public": "AwardTitle",
    "Abstract_Public": "AwardAbstract",
}
MANUAL_CODING = "Manual"
SECOND_SOURCE_FUNDER = "Department of Health and Social Care"
SECOND_SOURCE_RENAMES = {
    "ukcrc_value": "HC",
    "hrcs_rac_category": "RA_top",
    "ukcrc_value_rac": "RA",
    "project_title": "AwardTitle",
    "scientific_abstract": "AwardAbstract",
    "project_id": "OrganisationReference",
}
OUT_OF_SCOPE_CODES = ["9.1", "9.2"]
PLACEHOLDER_HC = ["Awaiting Health Category Coding", "Will Not Be Health Category Coded"]
SUBGROUP_FUNDER = "Wellcome Trust"

# Characters removed from the left of a cleaned column: ASCII punctuation
# followed by ASCII whitespace.
LSTRIP_CHARS = string.punctuation + string.whitespace

# Unicode whitespace as a regex character class body.  This is exactly the
# set of code points for which str.isspace() is true, written with \x{..}
# escapes so the same class works in Java regex (Spark) and RE2 (DuckDB).
WS_CLASS = (
    r"\t\n\x{0B}\f\r\x{1C}-\x{1F} \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
)

# --------------------------------------------------------------------------
# Demo rule set for the driver's synthetic ``documents`` table (ours).
# --------------------------------------------------------------------------

DEMO_TITLE_RULES = {
    "drop": ["the and attion to thanedble the, anea. eriner thanea."],
    "prefixes": ["erreth was", "nicht "],
    "nulls": ["in in oredble ea.", "to oned onerntat thatthtieror."],
    "boiler_plate": ["the ", "theand ", "and ", "of[,]? "],
}

DEMO_ABSTRACT_RULES = {
    "drop": ["released under the mit license."],
    "prefixes": [],
    "nulls": [
        "this work is licensed under the gnu general public license, version 3.",
        "of.",
    ],
    "boiler_plate": ["the ", "and ", "is ", "[0-9]+ "],
}
