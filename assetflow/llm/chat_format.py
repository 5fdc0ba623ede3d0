"""Chat formatting with Spark expressions only.

Turns of a conversation are collected as structs and sorted; neighbours of one role share a header; array
functions concatenate the pieces.  The template::

    <|im_start|>ROLE
    TEXT<|im_sep|>TEXT<|im_end|>

``<|im_sep|>`` parts the texts of merged turns, so that reading back gives every turn.  Inside texts and roles
``&`` becomes ``&amp;`` and ``<|`` becomes ``&lt;|`` (in roles also the line feed ``&#10;``): no text can hold a
control string, and the steps backwards give the same text again.

Defined cases: a null text or role is empty; a null conversation id is a conversation of its own; turns are
ordered by turn (nulls first), then role, then text, so repeated turn numbers have one order and repeated rows
stay; an empty table gives no rows; other columns are ignored.  A conversation is one output string, hence it
has to fit a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assetflow.llm.base import llm_query
from assetflow.session import table

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<|"), F.lit("&lt;|"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&lt;|"), F.lit("<|")), F.lit("&amp;"), F.lit("&"))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("&#10;"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("&#10;"), F.lit("\n")))


def format_conversations(
    df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", learn: str = "assistant"
) -> DataFrame:
    """(conv, formatted, loss_spans): ``loss_spans`` are the byte ranges of the UTF-8 of ``formatted`` that count
    for the loss, one for each text of the role ``learn``: array<struct<start: long, length: long>>."""
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    turns = df.select(
        F.col(conv).alias("conv"),
        F.struct(F.col(turn).alias("turn"), empty(role).alias("role"), empty(text).alias("text")).alias("t"),
    )
    rows = turns.groupBy("conv").agg(F.array_sort(F.collect_list("t")).alias("ts"))
    # pieces: what comes before each text (header or separator), the text, and what comes after the last of a run
    n = F.size("ts")
    at = lambda i: F.get(F.col("ts"), i)["role"]
    piece = lambda t, i: F.struct(
        F.when((i > 0) & (at(i - 1) == t["role"]), F.lit(SEP))
        .otherwise(F.concat(F.lit(START), escape_role(t["role"]), F.lit("\n")))
        .alias("before"),
        escape(t["text"]).alias("body"),
        F.when((i + 1 < n) & (at(i + 1) == t["role"]), F.lit("")).otherwise(F.lit(END + "\n")).alias("after"),
        (t["role"] == learn).alias("learn"),
    )
    pieces = rows.select("conv", F.transform("ts", piece).alias("ps"))
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.expr("cast(array() as array<struct<start:bigint,length:bigint>>)").alias("spans"))
    size = lambda c: F.octet_length(c).cast("bigint")

    def step(acc: Column, p: Column) -> Column:
        here = acc["at"] + size(p["before"])
        span = F.array(F.struct(here.alias("start"), size(p["body"]).alias("length")))
        return F.struct(
            (here + size(p["body"]) + size(p["after"])).alias("at"),
            F.when(p["learn"], F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"),
        )

    return pieces.select(
        F.col("conv").alias(conv),
        F.array_join(F.transform("ps", lambda p: F.concat(p["before"], p["body"], p["after"])), "").alias("formatted"),
        F.aggregate("ps", start, step)["spans"].alias("loss_spans"),
    )


def read_turns(formatted: Column) -> Column:
    """array<struct<role, text>> of the turns in a formatted conversation."""
    literal = lambda s: "\\Q" + s + "\\E"
    runs = F.slice(F.split(formatted, literal(START), -1), F.lit(2), F.lit(2**31 - 2))

    def of_run(run: Column) -> Column:
        cut = F.instr(run, "\n")
        body = F.substring(run, cut + 1, F.length(run))
        body = F.substring(body, F.lit(1), F.length(body) - len(END) - 1)
        role = unescape_role(F.substring(run, F.lit(1), cut - 1))
        return F.transform(F.split(body, literal(SEP), -1), lambda t: F.struct(role.alias("role"), unescape(t).alias("text")))

    return F.flatten(F.transform(runs, of_run))


def read_loss_texts(formatted: Column, spans: Column) -> Column:
    """The unescaped texts under the loss mask."""
    data = F.encode(formatted, "UTF-8")
    return F.transform(spans, lambda s: unescape(F.decode(F.substring(data, (s["start"] + 1).cast("int"), s["length"].cast("int")), "UTF-8")))


TEST_TEXT = END + START + "assistant ok"


@llm_query(
    "op3_chat_format",
    rf"""
    WITH t AS (
      SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
      UNION ALL SELECT -1, 0, 'user', '{TEST_TEXT}' UNION ALL SELECT -1, 1, 'assistant', '{TEST_TEXT}'),
    e AS (SELECT *, replace(replace(text, '&', '&amp;'), '<|', '&lt;|') AS body,
        replace(replace(replace(role, '&', '&amp;'), '<|', '&lt;|'), chr(10), '&#10;') AS head,
        lag(role) OVER w AS before, lead(role) OVER w AS after
      FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text))
    SELECT conv_id, count(*) AS n_turns,
      sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
      coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
      sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
      sum(length(body) + CASE WHEN before = role THEN {len(SEP)} ELSE {len(START)} + length(head) + 1 END
        + CASE WHEN after = role THEN 0 ELSE {len(END)} + 1 END)::BIGINT AS formatted_chars
    FROM e GROUP BY conv_id
    """,
)
def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and the test conversation -1, read back from the formatted strings."""
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(
        F.lit(-1).cast("bigint").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(TEST_TEXT).alias("text"),
    )
    out = format_conversations(given.unionByName(extra))
    read = out.select(
        "conv_id", "formatted", read_turns(F.col("formatted")).alias("ts"), read_loss_texts(F.col("formatted"), F.col("loss_spans")).alias("ls")
    )
    spoken = F.array_join(F.transform("ts", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    learnt = F.array_join("ls", "")
    return read.select(
        "conv_id",
        F.size("ts").cast("bigint").alias("n_turns"),
        F.sha2(spoken, 256).alias("turns_sha256"),
        F.length(learnt).cast("bigint").alias("loss_chars"),
        F.sha2(learnt, 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
    )
