"""A batch asks for a state a group of records, not a record; rows without a record pass, as by SQL."""

import pandas as pd

from siltstone.streaming import retract as T


class Value:
    def __init__(self):
        self.kept, self.asked = None, 0

    def exists(self):
        return self.kept is not None

    def get(self):
        self.asked += 1
        return self.kept

    def update(self, value):
        self.asked += 1
        self.kept = value


def test_many_records_share_a_state():
    processor, state = T.Cutoffs(), Value()
    processor.init(type("Handle", (), {"getValueState": lambda self, *_: state})())
    said = lambda key, *rows: [tuple(r) for f in processor.handleInputRows((key,), iter([pd.DataFrame(rows, columns=["record", "event_id", "at", "deleted"])]), None) for r in f[["record", "event_id", "at", "cutoff"]].values.tolist()]
    first = said(3, *((r, 10 + r, 5, True) for r in range(200)), *((r, 500 + r, 4 + r % 2, False) for r in range(300)))
    assert sorted(x for x in first if x[3]) == [(r, 10 + r, 5, True) for r in range(200)]
    assert sorted(x[0] for x in first if not x[3]) == [r for r in range(300) if r >= 200 or r % 2]
    assert state.asked == 1
    assert said(3, (7, 17, 5, True), (7, 16, 5, False), (7, 18, 5, False), (250, 1, 1, False)) == [(7, 18, 5, False), (250, 1, 1, False)]
    assert state.asked == 2


def test_rows_without_a_record_pass(spark, tmp_path):
    rows = spark.createDataFrame([(1, 1, None, False), (2, 2, None, True), (3, 1, 8, False), (4, 2, 8, True), (5, 3, 8, False)], "event_id long, m int, record long, deleted boolean")
    rows = rows.selectExpr("event_id", "timestamp_ntz'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, m) AS accepted_at", "record", "deleted")
    rows.write.parquet(str(tmp_path / "in"))
    T.retract(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), str(tmp_path / "log"), str(tmp_path / "progress")).awaitTermination()
    assert {(r.record, r.event_id) for r in T.view(spark, str(tmp_path / "log")).collect()} == {(None, 1), (8, 5)}
