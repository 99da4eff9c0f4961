"""Published values of agreement, graded scores and the survey, from counts typed as rows."""

import pytest

from rajut.operators import aggregates, agreement

#: Counts of (first label, second label); c, p, w, m for correct, partial, wrong, missing. Their sums per
#: rater and the number of equal labels are the published ones.
NAMES = {"c": "correct", "p": "partial", "w": "wrong", "m": "missing"}
BIOLOGI = {"cc": 137, "pp": 3, "mm": 1, "cp": 2, "cm": 1, "pc": 3, "wc": 2, "mc": 1, "mp": 1}
KIMIA = {"cc": 105, "pp": 1, "ww": 1, "mm": 1, "cm": 18, "cp": 5, "cw": 4, "pc": 6, "wc": 24, "mc": 1}


@pytest.mark.parametrize("table, n, pa, pe, ac1", [(BIOLOGI, 151, 0.934, 0.040, 0.931), (KIMIA, 166, 0.651, 0.112, 0.607)])
def test_agreement_of_two_raters(spark, table, n, pa, pe, ac1):
    rows = [(NAMES[a], NAMES[b]) for (a, b), k in table.items() for _ in range(k)]
    got = agreement.gwet(spark.createDataFrame(rows, "r1_rating string, r2_rating string")).first()
    assert (got["n"], round(got["pa"], 3), round(got["pe"], 3), round(got["ac1"], 3)) == (n, pa, pe, ac1)


@pytest.mark.parametrize(
    "counts, added, want",
    [
        ((140, 6, 2, 3), 0, (0.952, 0.965, 0.958)),
        ((143, 6, 0, 2), 0, (0.970, 0.970, 0.970)),
        ((132, 7, 25, 2), 0, (0.819, 0.965, 0.886)),
        ((136, 6, 5, 19), 29, (0.866, 0.757, 0.808)),
        ((186, 40, 3, 11), 0, (0.870, 0.881, 0.875)),
    ],
)
def test_graded_scores_of_raters(spark, counts, added, want):
    rows = [("x", label, n) for label, n in zip(("correct", "partial", "wrong", "missing", "added"), (*counts, added))]
    got = agreement.graded_scores(spark.createDataFrame(rows, "who string, label string, weight int"), ["who"]).first()
    assert (round(got["precision"], 3), round(got["recall"], 3), round(got["f1"], 3)) == want


def test_survey_rates(spark):
    rows = [("Ya" if i < 116 else "Tidak", "Benar" if i < 115 else "Salah", "Benar" if i < 88 else "Terbalik" if i < 116 else "NA") for i in range(117)]
    got = aggregates.survey_rates(spark.createDataFrame(rows, "valid string, type_ok string, direction string")).first()
    assert (round(100 * got["validity"], 1), round(100 * got["type_rate"], 1), round(100 * got["direction_rate"], 1)) == (99.1, 98.3, 75.9)
