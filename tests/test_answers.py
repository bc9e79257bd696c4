import pytest

from graphloom.errors import GeneratedQueryError, PipelineDefinitionError, PromptError
from graphloom.operators import answers
from graphloom.plans.pipeline import Pipeline, from_config, resolve
from graphloom.streaming.incremental import sessions, upsert_stream, windowed_counts


@pytest.mark.parametrize(
    "sql",
    [
        "SELECT IDENTIFIER('java_method')('java.lang.System','getProperty','user.home')",
        "SELECT IDENTIFIER('ref' || 'lect')('java.lang.System','getProperty','user.home')",
        "SELECT 1 WHERE 'x' = IDENTIFIER('java_method')('java.lang.System','getProperty','user.home')",
        "SELECT (SELECT IDENTIFIER('abs')(1))",
        "WITH x AS (SELECT IDENTIFIER('abs')(-1) AS a) SELECT * FROM x",
        "SELECT * FROM IDENTIFIER('known')",
        "SELECT IDENTIFIER('id') FROM known",
        "SELECT sum(id) OVER (ORDER BY IDENTIFIER('reflect')('java.lang.System','exit','1')) FROM known",
        "SELECT transform(array(1), x -> IDENTIFIER('java_method')('java.lang.System','getProperty','user.home'))",
        "SELECT * FROM known LATERAL VIEW IDENTIFIER('explode')(array(1)) e AS x",
        "SELECT * FROM known LATERAL VIEW json_tuple('{}', 'a') e AS x",
        "SELECT :x", "SELECT ?", "SELECT * FROM range(5)", "FROM known |> SELECT id",
    ],
)
def test_names_made_by_expressions_are_refused(spark, sql):
    spark.range(3).createOrReplaceTempView("known")
    with pytest.raises(GeneratedQueryError):
        answers.check_read_only(spark, sql)


def test_usual_queries_pass_the_gate(spark):
    spark.range(3).createOrReplaceTempView("known")
    for sql in (
        "SELECT id, x FROM known LATERAL VIEW explode(array(1, 2)) e AS x",
        "SELECT CASE WHEN id > 1 THEN 'a' ELSE trim(' b ') END AS c, CAST(id AS STRING) || 'x', -id, id % 2 FROM known WHERE id BETWEEN 0 AND 5 AND NOT id IN (7) AND 'ab' LIKE 'a%' ORDER BY id DESC NULLS LAST LIMIT 2",
        "WITH t AS (SELECT id, row_number() OVER (PARTITION BY id % 2 ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS n FROM known) SELECT n, count(*) AS c FROM t GROUP BY ROLLUP(n) HAVING count(*) > 0",
        "SELECT * FROM known WHERE EXISTS (SELECT 1 FROM known) AND id <= (SELECT max(id) FROM known)",
        "SELECT transform(array(1), x -> x + 1) AS a, aggregate_of.b FROM (VALUES (1, 2)) AS aggregate_of(a, b)",
    ):
        assert spark.sql(answers.check_read_only(spark, sql)).collect()


def test_text_to_sql(spark):
    spark.range(3).createOrReplaceTempView("numbers")
    df, meta = answers.TextToSql(spark, lambda p: "Sure:\n```sql\nSELECT id FROM numbers WHERE id > 0;\n```").search("which?")
    assert sorted(r["id"] for r in df.collect()) == [1, 2] and meta["sql"].startswith("SELECT")
    for bad in ("DROP TABLE numbers", "WITH x AS (SELECT 1) INSERT INTO numbers SELECT * FROM x", "SELECT (1", "SELECT 1; SELECT 2",
                "SELECT TRANSFORM(id) USING 'echo ran_shell' AS (x) FROM range(1)", "SELECT reflect('java.lang.System', 'exit', 1)", "SELECT java_method('a', 'b')",
                "SELECT * FROM text.`/etc/hostname`", "SELECT * FROM numbers WHERE id IN (SELECT value FROM text.`/etc/hostname`)", "SELECT (SELECT max(value) FROM text.`/etc/hostname`)",
                "WITH x AS (SELECT reflect('a', 'b')) SELECT * FROM x", "SELECT * FROM nowhere", "SELECT id FROM numbers ORDER BY reflect('a', 'b')"):
        with pytest.raises(GeneratedQueryError):
            answers.check_read_only(spark, bad)
    for good in ("WITH x AS (SELECT id, count(*) AS n FROM numbers GROUP BY id HAVING count(*) > 0) SELECT x.id, rank() OVER (ORDER BY n DESC) FROM x JOIN numbers USING (id) ORDER BY 1 LIMIT 3",
                 "SELECT id FROM numbers WHERE id = (SELECT max(id) FROM numbers) OR EXISTS (SELECT 1 FROM numbers) UNION ALL SELECT CASE WHEN id > 1 THEN id END FROM numbers"):
        assert spark.sql(answers.check_read_only(spark, good)).collect()


def test_tools(spark):
    def search(query: str, top_k: int = 5, alpha: float = 0.5) -> list:
        return [query] * top_k

    tool = answers.retriever_tool("search", "find", search)
    p = tool.parameters()
    assert p["required"] == ["query"] and p["properties"]["top_k"] == {"type": "integer", "minimum": 1}
    broken = answers.Tool("broken", "fails", lambda: 1 / 0)
    one = answers.Tool("one", "a number", lambda: 7)
    chosen = [("search", {"query": "x", "top_k": 2}), ("broken", {}), ("one", {}), ("missing", {})]
    df, meta = answers.ToolsRetriever(spark, lambda q, t: chosen, [tool, broken, one]).search("?")
    assert sorted((r["tool_name"], r["content"]) for r in df.collect()) == [("one", "7"), ("search", "x"), ("search", "x")]
    assert meta["errors"].keys() == {"broken", "missing"}


def test_answers(spark):
    said = []

    def model(prompt):
        said.append(prompt)
        return "an answer"

    rag = answers.GraphAnswers(lambda q, n=2: spark.createDataFrame([("fact",)] * n, "content string"), model)
    assert rag.search("q?", n=1) == {"answer": "an answer", "context": ["fact"]}
    rag.search("q?", history=[{"role": "user", "content": "before"}])
    assert "before" in said[1]
    none = answers.GraphAnswers(lambda q: spark.createDataFrame([], "content string"), model, fallback="nothing")
    assert none.search("q?")["answer"] == "nothing"
    with pytest.raises(PromptError):
        rag.search("")
    with pytest.raises(PromptError):
        answers.PromptTemplate("x", ("question",))
    with pytest.raises(PromptError):
        answers.ANSWER.format(question="x")


def test_retry():
    waits, calls = [], []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise OSError
        return "done"

    assert answers.retry(flaky, sleep=waits.append) == "done" and len(waits) == 2
    with pytest.raises(ZeroDivisionError):
        answers.retry(lambda: 1 / 0, attempts=2, sleep=waits.append)


@pytest.mark.parametrize(
    ("text", "want"),
    [('x {"a": 1} y', '{"a": 1}'), ('{"a": [1, 2', '{"a": [1, 2]}'), ('{"a": "b', '{"a": "b"}'), ('{"a": 1,}', '{"a": 1}'), ("none", "{}"), ('{"a": "}"}', '{"a": "}"}')],
)
def test_repair_json(text, want):
    assert answers.repair_json(text) == want


def test_extraction(spark):
    def model(text):
        return '{"nodes": [{"id": "0", "label": "P", "properties": {"name": "%s"}}, {"id": "1", "label": "P"}], "relationships": [{"type": "R", "start_node_id": "0", "end_node_id": "1"}]' % text

    chunks = spark.createDataFrame([("c1", "Ann"), ("c2", "Bob")], "chunk_id string, chunk string")
    n, e = answers.extract_graph(chunks, model)
    assert sorted(r["id"] for r in n.collect()) == ["c1:0", "c1:1", "c2:0", "c2:1"]
    assert sorted((r["src"], r["dst"]) for r in e.collect()) == [("c1:0", "c1:1"), ("c2:0", "c2:1")]


def test_pipeline():
    p = Pipeline().add("a", lambda x: {"y": x + 1}).add("b", lambda y, z=1: y * z).connect("a", "b", {"y": "a.y"})
    assert p.run({"a": {"x": 2}, "b": {"z": 5}}) == {"b": 15}
    assert [e["event"] for e in p.stream({"a": {"x": 2}})][:3] == ["PIPELINE_STARTED", "TASK_STARTED", "TASK_FINISHED"]
    with pytest.raises(PipelineDefinitionError):
        p.connect("b", "a")
    for bad in (lambda q: q.add("a", len), lambda q: q.connect("a", "zz"), lambda q: q.run({})):
        with pytest.raises(PipelineDefinitionError):
            bad(Pipeline().add("a", lambda x: x))


def test_pipeline_from_config(monkeypatch):
    monkeypatch.setenv("SOME_NUMBER", "3")
    config = {
        "deep": {"k": "v"},
        "component_config": {"n": {"class_": "builtins.int", "run_params_": {}}, "s": {"class_": "operator.neg"}},
        "connection_config": [],
    }
    pipeline, _ = from_config(config)
    assert pipeline.order() == ["n", "s"]
    assert resolve({"a": {"resolver_": "ENV", "var_": "SOME_NUMBER"}, "b": [{"resolver_": "CONFIG_KEY", "key_": "deep.k"}]}, config) == {"a": "3", "b": ["v"]}


def test_streaming_upserts_and_windows(spark, tmp_path):
    source, target = tmp_path / "in", tmp_path / "out"
    schema = "chapter int, index int, text string, seq int"
    spark.createDataFrame([(1, 0, "old", 1), (1, 1, "b", 2)], schema).write.parquet(str(source / "b1"))
    for n, rows in enumerate(([(1, 0, "new", 3), (2, 0, "c", 4)], [])):
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(str(source))
        q = upsert_stream(stream, str(target), ["chapter", "index"], str(tmp_path / "cp"), order="seq").trigger(availableNow=True).start()
        q.awaitTermination(60)
        if rows:
            spark.createDataFrame(rows, schema).write.parquet(str(source / f"c{n}"))
    out = sorted((r["chapter"], r["index"], r["text"]) for r in spark.read.parquet(str(target)).collect())
    assert out == [(1, 0, "new"), (1, 1, "b"), (2, 0, "c")]
    events = spark.sql("select timestamp'2024-01-01 00:10:00' as ts, 'a' as event_type, 1.0D as value, 1 as user_id union all select timestamp'2024-01-01 00:50:00', 'a', 2.0D, 1")
    assert [(r["n"], r["total"]) for r in windowed_counts(events).collect()] == [(2, 3.0)]
    assert sorted(r["n"] for r in sessions(events).collect()) == [1, 1]
