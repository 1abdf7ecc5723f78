"""Journal texts of the event tape: dates in words, log lines and distilled notation, one text an event.

The synthetic prose mentions no dates, files or commands. These tables write each event as such a text, so
extraction has something to read that grows with the tape.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recollect.sources.tables import table

_EVENT = ("event_id", "coalesce(user_id, -1) u", "event_type t", "cast(get_json_object(props, '$.k') as int) k")


def said(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, anchor (microseconds), expression: when something happened, in one of eleven forms."""
    events = table(spark, sf_dir, "events").where("ts is not null").withColumn("ts", F.col("ts").cast("timestamp")).selectExpr(*_EVENT, "unix_micros(ts) anchor", "date_from_unix_date(cast(unix_micros(ts) div 86400000000 as int)) day")
    unit = "element_at(array('day', 'week', 'month', 'year'), cast(event_id % 4 as int) + 1)"
    forms = [
        "'yesterday'", "' Today '", f"concat('over the last ', k % 9 + 1, ' ', {unit}, 's')", "concat('Last ', element_at(array('week', 'month', 'year'), cast(event_id % 3 as int) + 1))", f"concat(k % 9 + 1, ' ', {unit}, 's ago')",
        "date_format(d, 'yyyy-MM-dd')", "date_format(d, 'dd-MMM-yyyy')", "date_format(d, 'MMMM d, yyyy')", "date_format(d, 'yyyyMMdd')", "date_format(d, 'MMM dd yyyy')", "concat(t, ' some day')",
    ]
    text = "case cast(event_id % 11 as int) " + " ".join(f"when {i} then {f}" for i, f in enumerate(forms)) + " end"
    return events.selectExpr("*", "date_sub(day, coalesce(k, 0) * 7) d").selectExpr("event_id", "anchor", f"{text} expression")


def log(events: DataFrame) -> DataFrame:
    """memory_id, realm, text of rows of the events table: what a client's transcript says of each; a column _file stays."""
    code = "md5(concat(t, k))"
    texts = [
        "concat('$ make k', k, ' token=', t, '\\n', t, ' done')",
        "concat('see /srv/app', u, '/k', k, '.py:', k + 1, ' and\\n/srv/app', u, '/k', k, '.py')",
        "concat('open https://example.org/', t, '/', k, ' for #', k)",
        f"concat('run ', substr({code}, 1, 8), '-', substr({code}, 9, 4), '-', substr({code}, 13, 4), '-', substr({code}, 17, 4), '-', substr({code}, 21, 12))",
        f"concat('ValueError: k', k, ' is missing\\nat commit ', {code})",
        "concat('nothing of note about ', t)",
    ]
    text = "case cast(event_id % 6 as int) " + " ".join(f"when {i} then {x}" for i, x in enumerate(texts)) + " end"
    kept = ["_file"] if "_file" in events.columns else []
    return events.selectExpr(*_EVENT, *kept).selectExpr("event_id memory_id", "concat('session:', u) realm", f"{text} text", *kept)


def notation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, text: each event in distilled notation, in one of six forms; the fifth is broken."""
    texts = [
        "concat('[PATTERN] [hooks] ', t, '->k', k, '→session', u, ' A:+0.3,0.2 F:CORE,PIVOT →@architecture\\n[ε] do_not_parse→code', event_id, '\\n[CITE] src/k', k, '.py:', event_id, ' why')",
        "concat('[GOTCHA] ', t, ' => {retry, k', k, '} A:-0.5,1.8\\nmore of it')",
        "concat('[DECISION] k', k, '→k', k + 1, '|cheaper A:+0.5,0.4')",
        "concat('[TRIPLET] session:', u, ' ', t, ' k', k, ' @yesterday A:+0.1,0.2 F:CORE')",
        "concat('[TRIPLET] ', t, '\\n[UNKNOWN] ', k, '\\nstray')",
        "concat('[INSIGHT] narrow $\\\\rightarrow$ k', k, '\\n---\\n[SOLUTION] look at @src/k', k, '.py:7\\n[TRIPLET] k', k, ' in all of it')",
    ]
    text = "case cast(event_id % 6 as int) " + " ".join(f"when {i} then {x}" for i, x in enumerate(texts)) + " end"
    return table(spark, sf_dir, "events").selectExpr(*_EVENT).selectExpr("event_id", f"{text} text")
