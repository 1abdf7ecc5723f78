import json
import uuid

from pyspark.sql import functions as F

from recollect.functions import extract
from recollect.operators import code
from recollect.sources.transcripts import read_transcripts
from recollect.streaming import queue

SF = "/root/testdata/sf0.001"


def test_transcripts_of_both_kinds_of_content(spark, tmp_path):
    lines = [
        {"type": "user", "message": {"role": "user", "content": "hello <system-reminder>x\ny</system-reminder>there"}},
        {"type": "assistant", "message": {"role": "assistant", "content": [{"type": "text", "text": "a"}, {"type": "tool_use"}, {"type": "text", "text": "b"}]}},
        {"type": "user", "message": {"role": "user", "content": "<system-reminder>only</system-reminder>"}},
    ]
    (tmp_path / "t.jsonl").write_text("\n".join([*map(json.dumps, lines), "not json", ""]))
    found = [(r.line, r.role, r.text) for r in read_transcripts(spark, f"file://{tmp_path}/t.jsonl").orderBy("line").collect()]
    assert found == [(0, "user", "hello there"), (1, "assistant", "a\nb")]


def test_chunks_cover_the_text_and_break_at_paragraphs():
    text = "a" * 90 + "\n\n" + "b" * 150
    spans = extract.chunks(text, 100, 10)
    assert spans[0] == (0, 92) and spans[-1][1] == len(text)
    assert all(a2 <= b1 for (_, b1), (a2, _) in zip(spans, spans[1:], strict=False))
    assert extract.chunks("", 100, 10) == [] and len(extract.chunks("x" * 50, 10, 10)) <= 50


def test_values_follow_anchors(spark):
    row = spark.createDataFrame([("at commit 12ab, Port: 7440 and report 5",)], "t string").select(extract.values("t").alias("v")).first()
    assert [(v.anchor, v.value) for v in row.v] == [("commit", "12ab"), ("port", "7440")]


def test_code_calls_are_resolved(spark):
    files = [("a.py", "def f():\n    return g()\n\ndef g():\n    return h()\n"), ("b.py", "def g():\n    pass\n\nclass C:\n    def m(self):\n        f()\n        print(1)\n"), ("c.py", "def ("), ("d.py", "g()")]
    found = {(r.path, r.name): (r.caller, r.resolution, r.target) for r in code.resolve(code.index(spark.createDataFrame(files, "path string, source string"))).collect()}
    assert found == {
        ("a.py", "g"): ("f", "unique_name", "a.py"), ("a.py", "h"): ("g", "unresolved", None), ("b.py", "f"): ("m", "unique_name", "a.py"),
        ("b.py", "print"): ("m", "unresolved", None), ("d.py", "g"): (None, "ambiguous", None),
    }


def test_the_queue_applies_each_message_once_over_restarts(spark, tmp_path):
    source, folder = f"file://{tmp_path}/in", f"file://{tmp_path}/out"
    events = spark.read.parquet(f"{SF}/events.parquet")
    events.limit(100).coalesce(1).write.parquet(source)
    stream = lambda: queue.once(queue.messages(spark, source), "400 days")
    applied, dead = queue.drain(stream(), folder)
    events.limit(150).withColumn("user_id", F.when(F.col("event_id") % 50 == 0, None).otherwise(F.col("user_id"))).coalesce(1).write.mode("append").parquet(source)
    queue.drain(stream(), folder)
    ids = [r[0] for r in spark.read.parquet(applied).select("event_id").collect()]
    broken = [r[0] for r in spark.read.parquet(dead).select("event_id").collect()]
    assert len(ids) == len(set(ids)) and len(ids) + len(broken) == 150


def test_heartbeat_windows(spark):
    name = f"beats_{uuid.uuid4().hex}"
    q = queue.heartbeats(queue.messages(spark, f"{SF}/events.parquet")).writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table(name).count() > 0
