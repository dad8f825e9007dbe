import datetime
import json
import os
import random
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import functions as F

from lakeingest.operators import registry as rg
from lakeingest.session import create_once
from lakeingest.streaming.registry import _parts, current_registry, stream_registry

A, R, C = rg.APPROVED, "PURCHASE_REFUNDED", "PURCHASE_CANCELED"


def simulate(events):
    """Events one after the other against a dictionary: the meaning of the labels."""
    entries, labels = {}, []
    for seq, event, email, tx in events:
        if not tx:
            label = "missing_transaction_id"
        elif event == A:
            if not email:
                label = "missing_email"
            elif tx in entries:
                label = "already_processed"
            else:
                entries[tx], label = [email, "ativa"], "success"
        elif event in (R, C):
            label = "revoked" if tx in entries else "transaction_not_found"
            if tx in entries:
                entries[tx][1] = "revogada"
        else:
            label = f"unhandled_event_{event}"
        labels.append((seq, label))
    return labels, {(tx, *v) for tx, v in entries.items()}


def random_events(n):
    rng = random.Random(5)
    return [(i, rng.choice([A, A, R, C, "X", None]), rng.choice(["a@x", f"u{i}@x", None]),
             rng.choice(["hot"] * 5 + [None] + [f"t{k}" for k in range(12)])) for i in range(n)]


def frame(spark, events):
    return spark.createDataFrame(events, "seq long, event string, email string, transaction_id string")


def test_sequences(spark):
    cases = [
        ([(A, "e")], ["success"], "ativa"), ([(A, "e"), (A, "e")], ["success", "already_processed"], "ativa"),
        ([(A, "e"), (R, None)], ["success", "revoked"], "revogada"), ([(R, None), (A, "e")], ["transaction_not_found", "success"], "ativa"),
        ([(A, "e"), (C, None), (A, "e")], ["success", "revoked", "already_processed"], "revogada"),
        ([(A, None), (A, "e")], ["missing_email", "success"], "ativa"),
    ]
    for case, labels, status in cases:
        df = frame(spark, [(i, ev, em, "T") for i, (ev, em) in enumerate(case)])
        assert [r.outcome for r in rg.event_outcomes(spark, df).orderBy("seq").collect()] == labels
        assert rg.fold_registry(df).first().status == status


def test_outcomes_and_fold_match_a_sequential_run(spark):
    events = random_events(1500)
    labels, entries = simulate(events)
    df = frame(spark, events)
    for hot in (rg.HOT_ROWS, 100):
        got = rg.event_outcomes(spark, df, hot_rows=hot).orderBy("seq").collect()
        assert [(r.seq, r.outcome) for r in got] == labels
    assert {(r.transaction_id, r.email, r.status) for r in rg.fold_registry(df).collect()} == entries


def test_extraction_and_token(spark):
    docs = [{"event": "purchase_approved", "data": {"buyer": {"email": "a"}, "purchase": {"transaction": "T"}}},
            {"event": "x", "data": {"buyer": {"email": ""}}, "email": "b", "transaction_id": "", "transaction": "U"},
            {"email": "c", "transaction_id": "V", "transaction": "W"}, {}]
    df = spark.createDataFrame([(i, json.dumps(d), "k" if i else "z") for i, d in enumerate(docs)], "seq long, payload string, token string")
    e = rg.extract_events(df).orderBy("seq")
    assert [(r.event, r.email, r.transaction_id) for r in e.collect()] == [
        (A, "a", "T"), ("X", "b", "U"), (None, "c", "V"), (None, None, None)]
    assert rg.authorized(e, "k").count() == 3 and rg.authorized(e, "").count() == 0


def test_append_evolve_lookup(spark, tmp_path):
    folder = str(tmp_path / "r")
    old = spark.createDataFrame([(1, "a@x", "2020"), (2, "b@x", "2021")], "id long, email string, emitida_em string")
    old.write.parquet(folder)
    rg.append_rows(spark, spark.createDataFrame([("c@x", "T1"), ("d@x", None)], "email string, transaction_id string"), folder)
    back = rg.read_registry(spark, folder)
    assert {r.status for r in back.collect()} == {"ativa"} and back.select("id").distinct().count() == 4
    assert sorted(r.id for r in back.where("email in ('c@x', 'd@x')").collect()) == [3, 4]
    rg.append_rows(spark, spark.range(50).selectExpr("concat('m', id) as email").repartition(7), folder)
    assert sorted(r.id for r in rg.read_registry(spark, folder).select("id").collect()) == list(range(1, 55))
    os.makedirs(f"{folder}/_dados/dead")  # what a writer that died has left
    with ThreadPoolExecutor(3) as pool:
        list(pool.map(lambda k: rg.append_rows(spark, spark.range(20).selectExpr(f"concat('w{k}-', id) as email"), folder), range(3)))
    got = rg.read_registry(spark, folder).select("id", "email").collect()
    assert sorted(r.id for r in got) == list(range(1, 115))
    for k in range(3):  # a writer's ids lie together
        ids = sorted(r.id for r in got if r.email.startswith(f"w{k}-"))
        assert ids == list(range(ids[0], ids[0] + 20))
    assert [c["number"] for c in rg.commits(spark, folder)] == [1, 2, 3, 4, 5]
    assert not create_once(spark, f"{folder}/_commits/{1:020d}.json", "{}") and len(rg.commits(spark, folder)) == 5
    keys = spark.createDataFrame([("T1",), (None,), ("T1",)], "transaction_id string")
    assert [r.email for r in rg.lookup(back, keys).collect()] == ["c@x"]


def test_expiry_and_validity(spark):
    df = spark.createDataFrame([("assinatura", None), ("assinatura", "2024-02-29"), ("perpetua", ""), ("perpetua", "2024-02-30")], "t string, v string")
    got = [tuple(r.e) for r in df.select(rg.expiry(F.col("t"), F.col("v")).alias("e")).collect()]
    assert got[1] == ("2024-02-29T23:59:59Z", None) and got[2] == (None, None)
    assert got[0][0] is None and got[0][1] and got[3][0] is None and got[3][1]
    day = datetime.date(2024, 5, 10)
    cases = [(None, None, "h", "valid"), ("2024-05-11T23:59:59Z", "", "h", "valid"), ("2024-05-10T23:59:59Z", "H1", "h1", "valid"),
             ("2024-05-09T23:59:59Z", None, "h", "expired"), ("2024-05", None, "h", "invalid_date"), ("2024-99-99x", None, "h", "invalid_date"),
             (None, "h1", "h2", "other_hardware"), (None, "h1", None, "other_hardware")]
    df = spark.createDataFrame([c[:3] for c in cases], "e string, b string, h string")
    got = [r[0] for r in df.select(rg.validity(F.col("e"), F.col("b"), F.col("h"), F.lit(day))).collect()]
    assert got == [c[3] for c in cases]


def test_stream_keeps_state_over_restarts(spark, tmp_path):
    events = random_events(300)
    _, entries = simulate(events)
    base = str(tmp_path)
    for part in (events[:100], events[100:], []):
        docs = [(s, json.dumps({"event": e, "email": m, "transaction": t})) for s, e, m, t in part]
        spark.createDataFrame(docs, "seq long, payload string").write.mode("append").parquet(base + "/in")
        source = spark.readStream.schema("seq long, payload string").parquet(base + "/in")
        stream_registry(source, base + "/out", base + "/ck").awaitTermination()
    got = current_registry(spark, base + "/out").collect()
    assert {(r.transaction_id, r.email, r.status) for r in got} == entries


def test_changes_are_merged(spark, tmp_path):
    """Snapshots replace the changes of many batches; an unfinished one does not count."""
    events = random_events(400)
    _, entries = simulate(events)
    base = str(tmp_path)
    for k in range(8):
        docs = [(s, json.dumps({"event": e, "email": m, "transaction": t})) for s, e, m, t in events[50 * k:50 * k + 50]]
        spark.createDataFrame(docs, "seq long, payload string").coalesce(1).write.mode("append").parquet(base + "/in")
        source = spark.readStream.schema("seq long, payload string").parquet(base + "/in")
        stream_registry(source, base + "/out", base + "/ck", share=0.1).awaitTermination()
    last, behind, snapshots, batches = _parts(spark, base + "/out")
    assert last == 7 and not behind and len(snapshots) <= 2 and len(batches) < 8
    os.makedirs(base + "/out/_retrato/lote=99")
    got = current_registry(spark, base + "/out").collect()
    assert {(r.transaction_id, r.email, r.status) for r in got} == entries
