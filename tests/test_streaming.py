import numpy as np

from separatrix.operators.models import LinearModel
from separatrix.streaming import online

SCHEMA = "n long, k long, x double, y int"


def rows(n=300):
    rng = np.random.default_rng(2)
    x = rng.normal(size=n)
    return [(i, int(i % 7 if i % 3 else 0), float(v), 1 if v + rng.normal() > 0 else -1) for i, v in enumerate(x)]


def write_batches(spark, folder, data, size=100):
    for start in range(0, len(data), size):
        spark.createDataFrame(data[start:start + size], SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def learn(data, eta):
    w = np.zeros(2)
    for _, _, x, y in data:
        e = y - w[0] - w[1] * x
        w += eta * e * np.array([1.0, x])
    return w


def stream(spark, folder):
    return online.read_stream(spark, folder, SCHEMA, files_per_batch=1)


def test_global_model_over_batches(spark, tmp_path):
    data = rows()
    write_batches(spark, f"{tmp_path}/in", data)
    table = online.WeightTable(spark, f"{tmp_path}/weights", 2)
    run = online.learn_stream(stream(spark, f"{tmp_path}/in"), ["x"], "y", ["n"], 0.05, table, f"{tmp_path}/state")
    run.awaitTermination()
    kept = table.read().collect()
    assert {r["batch_id"] for r in kept} == {0, 1, 2}
    last = [r["value"] for r in sorted(kept, key=lambda r: r["idx"]) if r["batch_id"] == 2]
    assert np.allclose(last, learn(data, 0.05))
    # A batch that runs again starts from the one before it.
    assert np.allclose(table.before(2), learn(data[:200], 0.05))
    table.write(2, last)
    assert table.read().filter("batch_id = 2").count() == 2


def per_key(spark, tmp_path, files):
    table = online.KeyedWeights(spark, f"{tmp_path}/models", "k", "long")
    source = online.read_stream(spark, f"{tmp_path}/in", SCHEMA, files_per_batch=files)
    online.learn_per_key(source, "k", ["x"], "y", ["n"], 0.05, table, f"{tmp_path}/state").awaitTermination()
    newest = table.read().agg({"batch_id": "max"}).first()[0]
    return {r["k"]: (r["seen"], r["w"]) for r in table.after(newest).collect()}, newest


def test_model_per_key_keeps_its_state(spark, tmp_path):
    data = rows()
    write_batches(spark, f"{tmp_path}/in", data)
    seen, newest = per_key(spark, tmp_path, 1)
    assert newest == 2
    for key in {d[1] for d in data}:
        mine = [d for d in data if d[1] == key]
        assert seen[key][0] == len(mine)
        assert np.allclose(seen[key][1], learn(mine, 0.05))


def test_large_key_in_files_out_of_order(spark, tmp_path):
    rng = np.random.default_rng(4)
    data = [(i, 1 if i % 50 else 2, float(v), 1 if v > 0.3 else -1) for i, v in enumerate(rng.normal(size=25_000))]
    mixed = [data[i] for i in rng.permutation(len(data))]
    write_batches(spark, f"{tmp_path}/in", mixed, 9000)
    seen, _ = per_key(spark, tmp_path, None)
    for key in (1, 2):
        mine = [d for d in data if d[1] == key]
        assert seen[key][0] == len(mine) and np.allclose(seen[key][1], learn(mine, 0.05), atol=1e-8)


def test_stateless_scores(spark, tmp_path):
    data = rows(50)
    write_batches(spark, f"{tmp_path}/in", data, 20)
    model = LinearModel(["x"], [0.1, -2.0])
    out = []
    online.run_available(
        online.score_stream(stream(spark, f"{tmp_path}/in"), model), lambda b, _: out.extend(b.collect()), f"{tmp_path}/state"
    )
    assert len(out) == 50
    assert all(r["prediction"] == (1 if 0.1 - 2.0 * r["x"] >= 0 else -1) for r in out)


def keyed_state(spark, tmp_path, **more):
    table = online.KeyedWeights(spark, f"{tmp_path}/models", "k", "long")
    run = online.learn_keyed_state(stream(spark, f"{tmp_path}/in"), "k", ["x"], "y", ["n"], 0.05, table, f"{tmp_path}/state", **more)
    run.awaitTermination()
    return table


def test_state_store_goes_on_after_a_restart(spark, tmp_path):
    data = rows()
    # The second part has some of the keys only, and rows that cannot be learned from.
    later = [(1000 + i, 2, 0.1 * i, 1) for i in range(40)] + [(2000, None, 1.0, 1), (2001, 3, None, 1), (2002, 3, 1.0, None)]
    write_batches(spark, f"{tmp_path}/in", data)
    table = keyed_state(spark, tmp_path)
    assert {r["batch_id"] for r in table.read().collect()} == {0, 1, 2}
    write_batches(spark, f"{tmp_path}/in", later)
    table = keyed_state(spark, tmp_path)
    # Keys without new rows are not written again.
    assert [r["k"] for r in table.read().filter("batch_id = 3").collect()] == [2]
    found = {r["k"]: (r["seen"], r["w"]) for r in online.newest(table).collect()}
    for key in {d[1] for d in data}:
        mine = [d for d in data + later if d[1] == key and None not in d]
        assert found[key][0] == len(mine) and np.allclose(found[key][1], learn(mine, 0.05))


def test_idle_keys_are_forgotten(spark, tmp_path):
    import time

    write_batches(spark, f"{tmp_path}/in", [(0, 1, 0.5, 1), (1, 2, 0.5, 1)])
    keyed_state(spark, tmp_path, idle_ms=1)
    time.sleep(1)
    # A batch in which the timers run out, then one with a row of key 1.
    for row in ((2, 3, 0.5, 1), (3, 1, 0.25, -1)):
        write_batches(spark, f"{tmp_path}/in", [row])
        table = keyed_state(spark, tmp_path, idle_ms=1)
    found = {r["k"]: (r["seen"], r["w"]) for r in online.newest(table).collect()}
    assert found[1][0] == 1 and np.allclose(found[1][1], learn([(3, 1, 0.25, -1)], 0.05))
