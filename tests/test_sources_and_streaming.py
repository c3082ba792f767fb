import json

import numpy as np
import pytest

from assize.sources import files, tables
from assize.streaming.answers import answer_stream, append_once, parse_rates


def test_record_files(spark, tmp_path):
    rows = [{"id": "1", "response": "a\nb"}, {"id": "2", "response": None, "reasoning_content": "r"}]
    (tmp_path / "a.json").write_text(json.dumps(rows, indent=4))
    (tmp_path / "b.jsonl").write_text("\n".join(map(json.dumps, rows)))
    (tmp_path / "c.json").write_text("\n".join(map(json.dumps, rows)))
    (tmp_path / "d.csv").write_text('id,response,reasoning_content\n1,"a\nb",\n2,,r\n')
    want = {("1", "a\nb", None), ("2", None, "r")}
    for n in ("a.json", "b.jsonl", "c.json", "d.csv"):
        assert {tuple(r) for r in files.read_records(spark, str(tmp_path / n)).collect()} == want, n
    with pytest.raises(ValueError):
        files.read_records(spark, str(tmp_path / "x.txt"))
    (tmp_path / "e.jsonl").write_text('{"id": "1", "response": "a"}\n{broken')
    with pytest.raises(Exception, match="(?i)malformed"):
        files.read_records(spark, str(tmp_path / "e.jsonl")).collect()
    assert files.read_records(spark, str(tmp_path / "e.jsonl"), strict=False).cache().where("_corrupt_record is not null").count() == 1


def test_matrix_config_and_names(spark, tmp_path):
    m = np.random.default_rng(1).normal(size=(25, 3)).astype(np.float32)
    np.save(tmp_path / "m.npy", m)
    got = sorted((r.row, r.embedding) for r in files.read_matrix(spark, str(tmp_path / "m.npy"), rows=10).collect())
    assert [r for r, _ in got] == list(range(25)) and np.allclose([v for _, v in got], m)
    (tmp_path / "c.json").write_text('{"model_id": "m", "use_vllm": true, "generation_args": {"n": 1}}')
    assert files.read_config(str(tmp_path / "c.json")).generation_args == {"n": 1}
    (tmp_path / "d.json").write_text('{"model_id": "m", "zzz": 1}')
    with pytest.raises(ValueError):
        files.read_config(str(tmp_path / "d.json"))
    with pytest.raises(NotImplementedError):
        files.read_config("c.yaml")
    assert files.save_name("org-set-part-one") == "part-one.json"


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, 0, "a"), (1, 1, "b")], "id int, seed int, response string")
    for _ in range(2):
        files.append_answers(df, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 4 and files.read_answers(spark, str(tmp_path / "out")).count() == 2
    a, b = files.write_version(df, str(tmp_path / "t")), files.write_version(df.limit(1), str(tmp_path / "t"))
    assert a.endswith("v000001") and b.endswith("v000002") and spark.read.parquet(a).count() == 2
    m = tmp_path / "m.json"
    files.write_metrics(df, str(m))
    assert len(json.loads(m.read_text())) == 2
    files.write_metrics(df.limit(1), str(m))
    assert json.loads(m.read_text()) == {"id": 1, "seed": 0, "response": "a"} and m.read_text().count("\n") > 3
    files.write_lines(df.repartition(3), str(tmp_path / "l"))
    files.write_lines(df.repartition(3), str(tmp_path / "l"))
    assert spark.read.json(str(tmp_path / "l")).count() == 2
    assert [r.id for r in files.debug_head(spark.range(50), "id", 3).collect()] == [0, 1, 2]


def test_stream_appends_each_answer_once(spark, tiny, tmp_path):
    t = spark.read.parquet(f"{tiny}/judge_responses.parquet")
    n = t.select("resp_id").distinct().count()
    t.repartition(4).write.parquet(str(tmp_path / "in"))
    schema = t.schema.simpleString()[7:-1].replace(":", " ", 1)
    s = answer_stream(spark, str(tmp_path / "in"), t.schema, files=2)
    append_once(s, str(tmp_path / "out"), str(tmp_path / "cp"), late="400 days").awaitTermination(120)
    out = spark.read.parquet(str(tmp_path / "out"))
    assert out.count() == out.select("resp_id").distinct().count() == n and schema
    append_once(answer_stream(spark, str(tmp_path / "in"), t.schema), str(tmp_path / "out"), str(tmp_path / "cp"), late="400 days").awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == n  # a second run resumes
    assert parse_rates(out).agg({"n": "sum"}).first()[0] == n
    assert parse_rates(s).isStreaming


def test_matrix_sink_and_rows_by_place(spark, tmp_path):
    df = spark.createDataFrame([(2, [3.0, 4.0]), (0, [1.0, 2.0]), (1, [0.0, 0.5])], "row long, embedding array<float>")
    files.write_matrix(df, str(tmp_path / "m.npy"))
    assert np.load(tmp_path / "m.npy").tolist() == [[1.0, 2.0], [0.0, 0.5], [3.0, 4.0]]
    got = files.take_rows(spark.range(10, 30, 2), [3, 0, 3, 99]).orderBy("place").collect()
    assert [(r.place, r.id) for r in got] == [(0, 16), (1, 10), (2, 16)]


def test_subsets_and_configurations(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "b")], "id long, task string")
    df.write.partitionBy("task").parquet(str(tmp_path / "t.parquet"))
    got = tables.subset(spark, str(tmp_path), "t", task="b")
    assert {r.id for r in got.collect()} == {2, 3}
    assert "PartitionFilters: [isnotnull(task" in got._jdf.queryExecution().toString()
    assert tables.subset(spark, str(tmp_path), "t", task="zzz").count() == 0
    with pytest.raises(ValueError):
        tables.subset(spark, str(tmp_path), "t", other="b")
    df.write.parquet(str(tmp_path / "set/main"))
    assert tables.configured(spark, str(tmp_path), "set").count() == 3 == tables.configured(spark, str(tmp_path), "set", "main").count()
    df.write.parquet(str(tmp_path / "set/more"))
    with pytest.raises(ValueError):
        tables.configured(spark, str(tmp_path), "set")


def test_settled_tables_are_cleared(spark, tmp_path, monkeypatch):
    from assize.plans import lineage

    monkeypatch.setattr(lineage, "shared_dir", lambda spark: f"file://{tmp_path}")
    assert lineage.settle(spark.range(5), "x").count() == 5 and any(tmp_path.iterdir())
    lineage.clear(spark)
    assert not any(p.suffix != ".crc" for p in tmp_path.iterdir())
    lineage.clear(spark)
