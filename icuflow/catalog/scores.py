"""Keys of the severity scores and the echo notes."""

from __future__ import annotations

from icuflow.catalog.clinical_sql import with_views
from icuflow.catalog.feature_sql import FEATURES, rounded
from icuflow.catalog.features import STAY, tidy
from icuflow.catalog.registry import query
from icuflow.catalog.score_sql import SCORES
from icuflow.plans import scores as plan
from icuflow.plans.echo import NUMBER_PATTERNS, TEXT_PATTERNS, echo_notes
from icuflow.rules import scores as sc
from icuflow.sources.clinical import clinical_views
from icuflow.sources.tables import stage

OASIS_IDS = [*STAY, "icustay_age_group", "hospital_expire_flag", "icustay_expire_flag", "oasis"]
OASIS_NUM = ["age", "preiculos", "gcs", *sc.OASIS_DRIVERS, "urineoutput", "mechvent", "electivesurgery", *sc.OASIS, "oasis_prob"]
LATER = [p for table in (sc.SAPS, sc.SAPS2) for p in table if p not in sc.ALL_SCORES_SHARED]


def score(key, build, names, keep, times=()):
    sql = with_views(rounded(key, names, keep, times), key, extra={**FEATURES, **SCORES})

    def run(spark, folder):
        views = clinical_views(spark, folder, stage)
        return tidy(build(views, plan.score_features(views, key, stage)), names, keep, times)
    query(key, sql)(run)


score("oasis", plan.oasis, OASIS_NUM, OASIS_IDS)
score("saps", plan.saps, list(sc.SAPS), [*STAY, "saps"])
score("saps2", plan.saps2, ["sapsii", "sapsii_prob", *sc.SAPS2], STAY)
score("sofa", plan.sofa, list(sc.SOFA), [*STAY, "sofa"])
score("all_scores", plan.all_scores,
      list(dict.fromkeys([*OASIS_NUM, "saps", "sapsii", "sapsii_prob", *LATER, "sofa", *sc.SOFA])), OASIS_IDS)
ECHO_KEEP, ECHO_TIMES = ["row_id", "subject_id", "hadm_id", *TEXT_PATTERNS], ["chartdate", "charttime"]


@query("echo_notes", with_views(rounded("echo_notes", list(NUMBER_PATTERNS), ECHO_KEEP, ECHO_TIMES), "echo_notes", extra=SCORES))
def _echo(spark, folder):
    return tidy(echo_notes(clinical_views(spark, folder)["noteevents"]), list(NUMBER_PATTERNS), ECHO_KEEP, ECHO_TIMES)
