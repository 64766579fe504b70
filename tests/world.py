"""The small fixture world of FIXTURES.md part A: eight items, three themes, orthogonal vectors."""

from datetime import datetime, timedelta

from recspark.config import RecConfig
from recspark.operators.scoring import Catalogue
from recspark.operators.signals import VisitorModel

NOW = datetime(2026, 6, 10, 12, 0, 0)
ITEMS = [
    ("101", 0, "Forced Labor", "workshops", 52.7581, 9.9062),
    ("102", 0, "Forced Labor", "work detail", 52.7576, 9.9081),
    ("103", 0, "Forced Labor", "work detail", 52.7583, 9.9079),
    ("201", 1, "Family", "children", 52.7562, 9.9105),
    ("202", 1, "Family", "family life", 52.7568, 9.9111),
    ("203", 1, "Family", "siblings", 52.7565, 9.9098),
    ("301", 2, "Liberation", "camp liberation", 52.7597, 9.9041),
    ("302", 2, "Liberation", "liberator", 52.7599, 9.9048),
]
EVENT_COLUMNS = (
    "event_id bigint, user_id string, event string, ts timestamp, content_id string, dwell_seconds double, end_reason string, "
    "impressions array<string>, survey_answers map<string,array<string>>"
)


def catalogue(spark):
    contents = spark.createDataFrame(
        [(i, f"Item {i}", "", 120, False, lat, lon, [1944]) for i, _, _, _, lat, lon in ITEMS],
        "content_id string, title string, text string, word_count int, has_image boolean, lat double, lon double, years array<int>",
    )
    tags = spark.createDataFrame(
        [
            (i, p, f, lbl, w, f"{f}:{lbl}")
            for i, _, theme, sub, _, _ in ITEMS
            for p, (f, lbl, w) in enumerate(
                [("theme_what", theme, 1.0), ("theme_what", sub, 0.8), ("theme_how.type_of_stores", "Personal stories", 0.5)]
            )
        ],
        "content_id string, pos int, facet string, label string, weight double, key string",
    )
    vectors = spark.createDataFrame(
        [(i, [1.0 if d == axis else 0.0 for d in range(6)]) for i, axis, *_ in ITEMS], "content_id string, vec array<double>"
    )
    return Catalogue(contents, tags, vectors)


def view(user, content, dwell, reason, hours=1.0, visits=1, impressions=()):
    base = NOW - timedelta(hours=hours)
    rows = []
    for v in range(visits):
        t = base + timedelta(minutes=v)
        rows.append((user, "CONTENT_VIEW_STARTED", t, content, None, None, list(impressions), {}))
        rows.append((user, "CONTENT_VIEW_ENDED", t + timedelta(seconds=dwell), content, float(dwell), reason, [], {}))
    return rows


def events(spark, rows):
    return spark.createDataFrame([(n, *r) for n, r in enumerate(rows)], EVENT_COLUMNS)


def model(spark, rows, cfg=RecConfig(), now=NOW, provider=None):
    c = catalogue(spark)
    return VisitorModel(events(spark, rows), c.contents, c.tags, c.vectors, now, cfg, provider, stored=True)
