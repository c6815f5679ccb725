"""Text screening, questions and sessions."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfwise.catalog import inputs
from shelfwise.catalog.inputs import table
from shelfwise.catalog.registry import query
from shelfwise.functions import privacy
from shelfwise.operators import questions, sessions
from shelfwise.plans.quality_report import match_expectations


def _mask_sql(c: str) -> str:
    for pattern, mask in privacy.MASKS:
        c = f"regexp_replace({c}, '{pattern}', '{mask}', 'g')"
    return c


@query("mask_pii", f"SELECT doc_id, {_mask_sql('text')} AS text FROM documents")
def mask_pii(spark, folder):
    df = table(spark, folder, "documents")
    return df.select("doc_id", privacy.mask_pii(F.col("text")).alias("text"))


@query("mask_pii_strict")
def mask_pii_strict(spark, folder):
    df = table(spark, folder, "documents")
    return df.select("doc_id", privacy.mask_pii(F.col("text"), strict=True).alias("text"))


@query(
    "mask_table",
    f"""SELECT c_custkey, {_mask_sql('c_name')} AS c_name, '[REDACTED]' AS email,
               '[REDACTED]' AS phone, {_mask_sql("'call ' || (5550000 + c_custkey) || ' or mail c' || c_custkey || '@example.com'")}
                 AS contact
        FROM customer""",
)
def mask_table(spark, folder):
    df = table(spark, folder, "customer").select(
        "c_custkey",
        "c_name",
        F.concat(F.lit("c"), "c_custkey", F.lit("@example.com")).alias("email"),
        F.concat(F.lit("555-01"), "c_custkey").alias("phone"),
        F.concat(
            F.lit("call "), F.col("c_custkey") + 5550000, F.lit(" or mail c"), "c_custkey",
            F.lit("@example.com"),
        ).alias("contact"),
    )
    return privacy.mask_table(df)


CHAT_CTE = f"c AS ({inputs.CHAT})"
_INJECTED = " OR ".join(f"regexp_matches(text, '(?i){p}')" for p in privacy.INJECTION_PATTERNS.values())


@query(
    "flag_injection",
    f"""WITH {CHAT_CTE} SELECT conv_id, turn, {', '.join(
        f"regexp_matches(text, '(?i){p}') AS {n}" for n, p in privacy.INJECTION_PATTERNS.items()
    )}, {_INJECTED} AS flagged FROM c""",
)
def flag_injection(spark, folder):
    df = inputs.chat(spark, folder)
    text = F.col("text")
    return df.select(
        "conv_id",
        "turn",
        *[privacy.injection_flag(text, n).alias(n) for n in privacy.INJECTION_PATTERNS],
        privacy.has_injection(text).alias("flagged"),
    )


def _listed(words) -> str:
    return ", ".join(f"'{w}'" for w in words)


_TEXT = "trim(lower(text))"
_TOPIC = " OR ".join(f"contains({_TEXT}, '{t}')" for t in questions.EXTERNAL_TOPICS)
_RULES = (
    (_INJECTED, "refuse", "prompt injection"),
    (f"{_TEXT} IN ({_listed(questions.GREETINGS)})", "clarify", "greeting"),
    (_TOPIC, "refuse", "external facts"),
    (f"{_TEXT} IN ({_listed(questions.VAGUE_QUESTIONS)})", "clarify", "vague"),
)
_STATUS = "CASE " + " ".join(f"WHEN {t} THEN '{s}'" for t, s, _ in _RULES) + " ELSE 'ok' END"
_REASON = "CASE " + " ".join(f"WHEN {t} THEN '{r}'" for t, _, r in _RULES) + " END"


@query(
    "route_questions",
    f"WITH {CHAT_CTE} SELECT conv_id, turn, {_STATUS} AS status, {_REASON} AS reason FROM c",
)
def route_questions(spark, folder):
    df = inputs.chat(spark, folder)
    return df.select("conv_id", "turn", questions.route(F.col("text")).alias("r")).select(
        "conv_id", "turn", "r.*"
    )


_PHRASES = "|".join(questions.FOLLOW_UP_PHRASES)


@query(
    "flag_followup",
    f"""WITH {CHAT_CTE} SELECT conv_id, turn, regexp_matches({_TEXT}, '\\b({_PHRASES})\\b') AS follow_up,
          {' OR '.join(f"contains({_TEXT}, '{p}')" for p in questions.FOLLOW_UP_PHRASES)} AS loosely
        FROM c""",
)
def flag_followup(spark, folder):
    df = inputs.chat(spark, folder)
    text = F.col("text")
    return df.select(
        "conv_id",
        "turn",
        questions.is_follow_up(text).alias("follow_up"),
        questions.is_follow_up(text, whole_words=False).alias("loosely"),
    )


def _words_sql(words) -> str:
    parts = ", ".join(f"CASE WHEN contains({_TEXT}, '{w}') THEN '{w}' END" for w in words)
    return f"concat_ws(',', {parts})"


def _extract(pattern: str, group: int) -> str:
    return f"nullif(regexp_extract({_TEXT}, '{pattern}', {group}), '')"


_SIGN = _extract(questions.COMPARISON_PATTERN, 2)
_NAMES = " ".join(f"WHEN '{s}' THEN '{n}'" for s, n in questions.COMPARISON_NAMES.items())


@query(
    "extract_mentions",
    f"""WITH {CHAT_CTE} SELECT conv_id, turn, upper({_extract(questions.ID_PATTERN, 1)}) AS mentioned_id,
          {_words_sql(questions.REGIONS)} AS regions, {_words_sql(questions.STATUSES)} AS statuses,
          {_words_sql(questions.CATEGORIES)} AS categories,
          {_extract(questions.COMPARISON_PATTERN, 1)} AS compared_field,
          CASE {_SIGN} {_NAMES} END AS compared_op,
          TRY_CAST(replace({_extract(questions.COMPARISON_PATTERN, 3)}, '$', '') AS DOUBLE) AS compared_value,
          TRY_CAST({_extract(questions.TOP_PATTERN, 1)} AS INTEGER) AS top_n FROM c""",
)
def extract_mentions(spark, folder):
    df = inputs.chat(spark, folder)
    found = df.select("conv_id", "turn", questions.mentions(F.col("text")).alias("m")).select(
        "conv_id", "turn", "m.*"
    )
    return found.withColumns(
        {c: F.array_join(c, ",") for c in ("regions", "statuses", "categories")}
    )


@query(
    "expected_match",
    f"""WITH {CHAT_CTE}, r AS (SELECT conv_id, turn, {_STATUS} AS status FROM c),
        e AS (SELECT conv_id, turn, CASE WHEN (conv_id + turn) % 7 = 0 THEN 'refuse'
                WHEN (conv_id + turn) % 11 = 0 THEN 'refuse' ELSE 'ok' END AS expected_status
              FROM conversations WHERE turn % 2 = 0)
        SELECT e.conv_id, e.turn, expected_status, status, status = expected_status AS expected_match
        FROM e JOIN r ON e.conv_id = r.conv_id AND e.turn = r.turn""",
)
def expected_match(spark, folder):
    at = F.col("conv_id") + F.col("turn")
    expected = table(spark, folder, "conversations").where("turn % 2 = 0").select(
        "conv_id",
        "turn",
        F.when((at % 7 == 0) | (at % 11 == 0), "refuse").otherwise("ok").alias("status"),
    )
    routed = route_questions(spark, folder).select("conv_id", "turn", "status")
    return match_expectations(routed, expected, ["conv_id", "turn"])


def _turns(spark, folder):
    """Turns of a session per user of the events, numbered in time order."""
    events = table(spark, folder, "events")
    hour = F.date_trunc("hour", "ts")
    numbered = sessions.running_sums(
        events, ["user_id"], hour, ["ts", "event_id"], {"turn": F.lit(1).cast("bigint")}
    )
    named = F.concat(F.lit("f"), (F.col("event_id") % 5).cast("string"))
    return numbered.select(
        F.col("user_id").alias("session_id"),
        "turn",
        F.col("event_type").isin("view", "click").alias("follow_up"),
        F.when(F.col("event_type") != "error", named).alias("flt"),
    )


TURNS = """SELECT user_id AS session_id,
    row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS turn,
    event_type IN ('view', 'click') AS follow_up,
    CASE WHEN event_type = 'error' THEN NULL ELSE concat('f', CAST(event_id % 5 AS VARCHAR)) END AS flt
    FROM events"""


@query(
    "session_filters",
    f"""WITH t AS ({TURNS}), s AS (SELECT *, CAST(sum(CASE WHEN NOT follow_up AND flt IS NOT NULL
            THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY turn ROWS UNBOUNDED PRECEDING)
            AS BIGINT) AS segment FROM t),
        a AS (SELECT *, coalesce(array_to_string(list(flt) FILTER (WHERE flt IS NOT NULL) OVER (
            PARTITION BY session_id, segment ORDER BY turn
            ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), ','), '') AS accumulated FROM s)
        SELECT session_id, turn, segment, accumulated,
          CASE WHEN follow_up THEN accumulated ELSE coalesce(flt, '') END AS effective FROM a""",
)
def session_filters(spark, folder):
    turns = _turns(spark, folder).withColumn("filters", F.array_compact(F.array("flt")))
    found = sessions.session_filters(turns)
    return found.select(
        "session_id",
        "turn",
        "segment",
        F.array_join("accumulated", ",").alias("accumulated"),
        F.array_join("effective", ",").alias("effective"),
    )


@query(
    "session_filters_distinct",
    f"""WITH t AS ({TURNS}), s AS (SELECT *, CAST(sum(CASE WHEN NOT follow_up AND flt IS NOT NULL
            THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY turn ROWS UNBOUNDED PRECEDING)
            AS BIGINT) AS segment FROM t),
        p AS (SELECT t.session_id, t.turn, t.segment, f.flt, max(f.turn) AS last FROM s t LEFT JOIN s f
            ON t.session_id = f.session_id AND t.segment = f.segment AND f.turn <= t.turn AND f.flt IS NOT NULL
            GROUP BY ALL)
        SELECT session_id, turn, segment, count(flt)::INTEGER AS kept,
          coalesce(string_agg(flt || '@' || last, ',' ORDER BY last), '') AS held FROM p GROUP BY ALL""",
)
def session_filters_distinct(spark, folder):
    turns = _turns(spark, folder)
    one = F.struct(F.col("flt").alias("field"), F.col("turn").cast("string").alias("value"))
    filters = F.array_compact(F.array(F.when(F.col("flt").isNotNull(), one)))
    found = sessions.session_filters(turns.withColumn("filters", filters), distinct_fields=True)
    held = F.transform("accumulated", lambda f: F.concat(f["field"], F.lit("@"), f["value"]))
    return found.select(
        "session_id", "turn", "segment", F.size("accumulated").alias("kept"), F.array_join(held, ",").alias("held")
    )
