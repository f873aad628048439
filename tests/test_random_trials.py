from custaris.operators import models as M
from custaris.plans import training as T


def test_both_searches_draw_thirty_random_points():
    """Registered churn and revenue tuning share this search; the reference draws 30 points."""
    asked = []

    def search(points):
        asked.append(points)
        return [(p, 0.0) for p in points], points[0]
    space = {"n_estimators": M.whole(2, 4000), "max_depth": M.whole(1, 2)}
    got = T.both_tuners(search, {"n_estimators": [2], "max_depth": [2]}, space)
    assert sorted(map(len, asked)) == [1, 30]
    assert len(got["random"]) == 30 and len({p["n_estimators"] for p, _ in got["random"]}) > 20
