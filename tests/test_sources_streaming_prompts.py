import json

import pytest
from pyspark.sql import functions as F

from tallyloom.operators import curation, predict, prompts
from tallyloom.sources import tables
from tallyloom.streaming import scoring


def test_read_table_by_extension(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"x": 1}, {"x": 2}]))
    (tmp_path / "b.jsonl").write_text('{"x": 1}\n{"x": 2}\n')
    (tmp_path / "c.csv").write_text('x,y\n1,"a ""q"" b"\n')
    (tmp_path / "d.tsv").write_text("x\ty\n1\tb\n")
    (tmp_path / "e.pkl").write_text("")
    assert [r.x for r in tables.read_table(spark, str(tmp_path / "a.json")).orderBy("x").collect()] == [1, 2]
    assert tables.read_table(spark, str(tmp_path / "b.jsonl"), schema="x int, z string").count() == 2
    assert [tuple(r) for r in tables.read_table(spark, str(tmp_path / "c.csv")).collect()] == [("1", 'a "q" b')]
    assert tables.read_table(spark, str(tmp_path / "d.tsv"), infer=True).first().x == 1
    for bad in ("e.pkl", "f.xyz"):
        with pytest.raises(ValueError):
            tables.read_table(spark, str(tmp_path / bad))
    assert tables.existing(spark, [str(tmp_path / "a.json"), str(tmp_path / "no")]) == [str(tmp_path / "a.json")]
    with pytest.raises(FileNotFoundError):
        tables.existing(spark, [str(tmp_path / "no")])
    with pytest.raises(ValueError):
        tables.catalogued("nothing")
    assert len(tables.catalogued("SPAR-Bench")[0]) == 4


@pytest.mark.parametrize(
    "content,xs",
    [('{"x": 1}\n{"x": 2}\n{"x": 3}\n', [1, 2, 3]), ('\n  {"x": 1}\n', [1]), ('[{"x": 1},\n {"x": 2}]', [1, 2]), ('[{"x": 1}, {"x": 2}]', [1, 2]), ('{\n "x": 4\n}', [4]), ('{"x": 1}\nbroken\n{"x": 3}\n', [1, 3]), ("", [])],
)
def test_json_of_every_shape(spark, tmp_path, content, xs):
    (tmp_path / "a.json").write_text(content)
    assert sorted(r.x for r in tables.read_table(spark, str(tmp_path / "a.json"), schema="x int").where("x is not null").collect()) == xs


def test_media_as_data_urls(spark, tmp_path):
    (tmp_path / "a.png").write_bytes(b"\x89PNG\x00")
    assert tables.read_media(spark, str(tmp_path / "a.png")).first().url == "data:image;base64,iVBORwA="


def test_ingestion(spark):
    whole = {"gpt4o_response": "Question: how many? Answer: <think>a</think><answer>Answer: 4 Answer: 5</answer>", "image_path": "i.png", "question": "q", "answer": "a"}
    lines = [json.dumps(whole), json.dumps({**whole, "answer": None}), json.dumps({k: v for k, v in whole.items() if k != "question"}), "{broken", "", None, json.dumps({**whole, "gpt4o_response": "no tags"})]
    df = spark.createDataFrame([(i, x, "extra") for i, x in enumerate(lines)], "i int, line string, image_path string")
    got = {r.i: (r.image_path, r.problem, r.solution, r.original_question, r.original_answer) for r in curation.ingest_annotations(df).collect()}
    assert got[0] == ("i.png", "how many?", "<think>a</think>\n\n<answer>4 Answer: 5</answer>", "q", "a") and got[6] == ("i.png", "no tags", "<think></think>", "q", "a")
    assert all(got[i] == (None,) * 5 for i in range(1, 6))


def test_maps_keep_the_last_line(spark, tmp_path):
    (tmp_path / "m.jsonl").write_text('{"video_id":"v","cognitive_map":{"a":[[1,2]]},"object_list":["a"]}\n{"video_id":"v","cognitive_map":{"a":[[3,4]]},"object_list":["a"]}\n')
    assert tables.load_maps(spark, str(tmp_path / "m.jsonl")).first().cognitive_map == {"a": [[3, 4]]}


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, 0, "b"), (0, 1, "é"), (0, 0, "a")], "rank int, seq int, s string")
    tables.write_results(df, str(tmp_path / "out"))
    back = tables.read_table(spark, str(tmp_path / "out"), fmt="jsonl", schema="rank int, seq int, s string")
    assert [r.s for r in tables.merge_ranks(back, "rank", "seq").collect()] == ["a", "é", "b"]
    tables.write_metrics(spark.createDataFrame([('{"a":1}',)], "metrics string"), str(tmp_path / "m"))
    assert spark.read.text(str(tmp_path / "m")).first().value == '{"a":1}'


def test_failed_batches_give_empty_texts(spark):
    df = spark.createDataFrame([(i, f"p{i}") for i in range(6)], "i int, promt string").coalesce(1)

    def model(prompts_):
        if "p3" in prompts_:
            raise RuntimeError
        return [p.upper() for p in prompts_]

    assert [r.predicted_answer for r in predict.predicted(df, model, batch=2).orderBy("i").collect()] == ["P0", "P1", "", "", "P4", "P5"]


def test_prompts(spark):
    df = spark.createDataFrame([("q", ["x", "y"], "multiple choice", "video"), ("q", None, "free", "image")], "p string, o array<string>, t string, k string")
    got = df.select(prompts.options_block(F.col("p"), F.col("o"), F.col("t")).alias("b"), prompts.options_suffix(F.col("o")).alias("s"), prompts.lettered(F.col("o")).alias("l")).collect()
    assert tuple(got[0]) == ("qOptions:\nx\ny\n", "\nOptions:\nx\ny", "A. x\nB. y\n") and tuple(got[1])[:2] == ("q", "")
    chat = prompts.user_message(F.col("k"), F.lit("f.mp4"), F.col("p"))
    row = df.select(prompts.without_nulls(chat).alias("j"), prompts.vision_parts(chat).alias("v")).first()
    assert json.loads(row.j) == [{"role": "user", "content": [{"type": "video", "video": "f.mp4"}, {"type": "text", "text": "q"}]}] and row.v[0].video == "f.mp4"
    t = {"default": "D {Question}", "free": "F {Question}"}
    assert [r.template for r in prompts.with_template(df, t, "t", "default").orderBy("t").collect()] == ["F {Question}", "D {Question}"]
    with pytest.raises(Exception, match="unknown prompt kind"):
        prompts.with_template(df, t, "t", "default", strict=True).collect()


def test_map_prompts(spark):
    rows = [("q", "SR_dataset", {"lamp": [[1, 2]], "cook's": [[3, 4]]}, "numerical"), ("q", "SR_dataset", None, "numerical"), ("q", "other", None, "unheard of")]
    df = spark.createDataFrame(rows, "p string, s string, m map<string,array<array<int>>>, t string")
    c = prompts.map_aware(F.col("p"), F.col("m"), F.col("s"), F.col("t"), "P {Question}", "M {object_list} {map_example} {Question}", {"numerical": " N"}, "{}")
    got = [r[0] for r in df.coalesce(1).select(c).collect()]
    assert got[0] in ("M ['lamp', \"cook's\"] {} q N", "M [\"cook's\", 'lamp'] {} q N") and got[1:] == [None, "P q"]
    with pytest.raises(Exception, match="unknown prompt kind"):
        df.select(prompts.typed_prompt(F.col("p"), F.col("t"), "{Question}", {"numerical": "x"}, strict=True)).collect()


def test_vision_parts_of_several_conversations(spark):
    one = lambda kind: prompts.user_message(F.lit(kind), F.lit("f"), F.lit("q"))
    got = spark.range(1).select(prompts.vision_parts_of_all(F.array(one("image_url"), one("audio"), one("video"))).alias("v")).first().v
    assert [(p.type, p.image_url, p.video) for p in got] == [("image_url", "f", None), ("video", None, "f")]


def test_exclusion_and_media(spark):
    df = spark.createDataFrame([(1, "a/x.mp4"), (2, "y.mp4"), (3, None)], "i int, path string")
    listed = spark.createDataFrame([("x.mp4",), (None,)], "file_name string")
    assert sorted(r.i for r in curation.exclude_listed(df, listed, "path", "file_name").collect()) == [2, 3]
    assert [r.i for r in curation.with_media(df, df.where("i = 2").select("path"), "path").collect()] == [2]


def test_streamed_means_equal_batch_means(spark, tmp_path):
    rows = [(i, f"t{i % 2}", float(i % 5), f"2031-01-01 00:0{i % 6}:00") for i in range(60)]
    df = spark.createDataFrame(rows, "row_id bigint, task string, s double, at string").withColumn("at", F.to_timestamp("at"))
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    schema = "row_id bigint, task string, s double, at timestamp"
    stream = scoring.windowed_means(scoring.result_stream(spark, str(tmp_path / "in"), schema, "parquet"), F.col("s"), "task", "at", "10 minutes", "2 minutes")
    q = stream.writeStream.outputMode("complete").format("memory").queryName("means").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(r.start, r.task): (r.n, round(r.value, 9)) for r in spark.table("means").collect()}
    batch = scoring.windowed_means(df, F.col("s"), "task", "at", "10 minutes", "2 minutes")
    assert got == {(r.start, r.task): (r.n, round(r.value, 9)) for r in batch.collect()} and got
