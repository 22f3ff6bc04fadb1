r"""Chat formatting: budgeted, turn-aligned windows with a loss mask.

Template of a turn: ``<|im_start|>ROLE\nTEXT<|im_end|>\n``. A backslash escapes: inside roles and texts every backslash
is doubled and every control string gets a backslash after its first character (``[INST]`` becomes ``[\INST]``), so no
control string of this template or of the common others stands in a formatted text unless the template put it there;
in roles a line break gets a backslash before it. ``\x -> x`` undoes all of it.

Windows: a running sum of turn tokens over the conversation deals turns into cells of half the room; turns that start
in one cell form a span, and a turn above half the room is a span of its own, so a span never needs more than the room
unless one turn alone does. A window repeats the conversation's leading system turn and up to `history_turns` turns
before its span whose tokens fit `history_tokens`, then has the span's turns. Loss lies on the assistant texts of the
span only: a repeated target is masked. Every turn is in exactly one span. `over_budget` marks windows that a single
turn (with its system turn) makes longer than the budget.

Turn order: turn, then role, then text; null sorts first. A null text or role counts as empty, and rows with null
conv_id are one conversation. Rows that are equal throughout are turns of their own. Extra columns are ignored. An
empty table gives no windows. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
#: Control strings of this and of other public chat templates.
CONTROL = ("<|im_start|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")


def escape(text: Column) -> Column:
    text = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for c in CONTROL:
        text = F.replace(text, F.lit(c), F.lit(f"{c[0]}\\{c[1:]}"))
    return text


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def token_estimate(escaped: Column) -> Column:
    """Tokens of a turn: four characters each, and the template's own."""
    return F.ceil(F.length(escaped) / 4).cast("long") + 6


def format_windows(turns: DataFrame, budget: int = 1024, history_tokens: int = 256, history_turns: int = 4) -> DataFrame:
    """conv_id, window, text, loss array<struct<start,end>> (characters, end exclusive), n_repeated, n_turns, n_tokens, over_budget."""
    text, role = F.coalesce("text", F.lit("")), F.coalesce("role", F.lit(""))
    rows = turns.select("conv_id", "turn", role.alias("role"), text.alias("raw"))
    body = escape(F.col("raw"))
    name = F.replace(escape(F.col("role")), F.lit("\n"), F.lit("\\\n"))
    rows = rows.select("conv_id", "turn", "role", "raw", body.alias("body"), name.alias("name"))
    rows = rows.select(
        "conv_id", "turn", "role", "raw",
        token_estimate(F.concat("name", "body")).alias("tokens"),
        F.struct(
            F.concat(F.lit(OPEN), "name", F.lit("\n"), "body", F.lit(CLOSE)).alias("seg"),
            (F.length("name") + len(OPEN) + 1).alias("at"),
            F.length("body").alias("len"),
            (F.col("role") == "assistant").alias("target"),
        ).alias("piece"),
    )
    by = Window.partitionBy("conv_id").orderBy("turn", "role", "raw")
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    first = by.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.select(
        "conv_id", "piece", "tokens", "role",
        F.row_number().over(by).alias("rn"),
        F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("before"),
        F.first(F.when(F.col("role") == "system", F.struct("piece", "tokens"))).over(first).alias("system"),
        *[F.lag(F.struct("piece", "tokens", "role"), k).over(by).alias(f"h{k}") for k in range(1, history_turns + 1)],
    )
    system_tokens = F.coalesce(F.col("system.tokens"), F.lit(0))
    room = F.greatest(F.lit(budget - history_tokens) - system_tokens, F.lit(budget // 4))
    half = F.floor(room / 2)
    rows = rows.withColumn("cell", F.floor(F.col("before") / half)).withColumn("long", F.col("tokens") > half)
    by = Window.partitionBy("conv_id").orderBy("rn")
    starts = F.coalesce(F.col("long") | F.lag("long").over(by) | (F.col("cell") != F.lag("cell").over(by)), F.lit(True))
    rows = rows.withColumn("start", starts.cast("long")).withColumn("window", F.sum("start").over(by) - 1)
    # history, nearest turn first, while it fits; the retained system turn is never history
    fits, total = F.lit(True), F.lit(0)
    past = []
    for k in range(1, history_turns + 1):
        h = F.col(f"h{k}")
        total = total + F.coalesce(h["tokens"], F.lit(0))
        fits = fits & h.isNotNull() & (total <= history_tokens) & ~((F.col("rn") - k == 1) & F.coalesce(h["role"] == "system", F.lit(False)))
        past.append(F.when(fits, F.struct(h["piece"].alias("piece"), h["tokens"].alias("tokens"))))
    kept = F.when((F.col("system").isNotNull()) & (F.col("rn") > 1), F.struct(F.col("system.piece").alias("piece"), F.col("system.tokens").alias("tokens")))
    context = F.when(F.col("start") == 1, F.array_compact(F.array(kept, *reversed(past))))
    spans = rows.select("conv_id", "window", "rn", "piece", "tokens", context.alias("context")).groupBy("conv_id", "window").agg(
        F.sort_array(F.collect_list(F.struct("rn", "piece", "tokens"))).alias("new"),
        F.first("context", ignorenulls=True).alias("context"),
    )
    spans = spans.select("conv_id", "window", F.size("context").alias("n_repeated"), F.concat(F.col("context"), F.transform("new", lambda x: F.struct(x["piece"].alias("piece"), x["tokens"].alias("tokens")))).alias("all"))
    spans = spans.withColumn("length", F.transform("all", lambda x: F.length(x["piece"]["seg"])))
    at = lambda i: F.aggregate(F.slice(F.col("length"), 1, i), F.lit(0), lambda a, x: a + x)
    place = lambda x, i: F.struct((at(i) + x["piece"]["at"]).alias("start"), (at(i) + x["piece"]["at"] + x["piece"]["len"]).alias("end"), (x["piece"]["target"] & (i >= F.col("n_repeated"))).alias("target"))
    loss = F.transform(F.filter(F.transform("all", place), lambda x: x["target"]), lambda x: F.struct(x["start"], x["end"]))
    n_tokens = F.aggregate("all", F.lit(0).cast("long"), lambda a, x: a + x["tokens"])
    return spans.select(
        "conv_id", "window",
        F.array_join(F.transform("all", lambda x: x["piece"]["seg"]), "").alias("text"),
        loss.alias("loss"), "n_repeated",
        (F.size("all") - F.col("n_repeated")).alias("n_turns"),
        n_tokens.alias("n_tokens"), (n_tokens > budget).alias("over_budget"),
    )


def read_back(windows: DataFrame) -> DataFrame:
    """conv_id, window, turns (role, text of each turn that is not repeated) and loss_text, read from text, loss and n_repeated alone."""
    turn = r"(?s)\A<\|im_start\|>((?:[^\\\n]++|\\.)*+)\n(.*)\z"
    parts = F.split("text", r"<\|im_end\|>\n")
    own = F.slice(parts, F.col("n_repeated") + 1, F.size(parts) - 1 - F.col("n_repeated"))
    turns = F.transform(own, lambda x: F.struct(unescape(F.regexp_extract(x, turn, 1)).alias("role"), unescape(F.regexp_extract(x, turn, 2)).alias("text")))
    loss = F.array_join(F.transform("loss", lambda x: unescape(F.substring(F.col("text"), x["start"] + 1, x["end"] - x["start"]))), "")
    return windows.select("conv_id", "window", turns.alias("turns"), loss.alias("loss_text"), F.length("text").alias("chars"))


def digest_conversations(windows: DataFrame) -> DataFrame:
    """One row per conversation. A digest of a whole conversation needs that conversation, and nothing else, in one row."""
    back = read_back(windows)
    said = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    per = back.select("conv_id", "window", said.alias("said"), F.size("turns").alias("n"), "loss_text", "chars").groupBy("conv_id").agg(
        F.sum("n").cast("long").alias("n_turns"),
        F.sort_array(F.collect_list(F.struct("window", "said", "loss_text"))).alias("w"),
        F.sum("chars").cast("long").alias("formatted_chars"),
    )
    join = lambda c: F.array_join(F.transform("w", lambda x: x[c]), "")
    per = per.select("conv_id", "n_turns", join("said").alias("said"), join("loss_text").alias("lost"), "formatted_chars")
    return per.select("conv_id", "n_turns", F.sha2(F.col("said").cast("binary"), 256).alias("turns_sha256"), F.length("lost").cast("long").alias("loss_chars"), F.sha2(F.col("lost").cast("binary"), 256).alias("loss_sha256"), "formatted_chars")


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    odd = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(odd).alias("text"))
    return digest_conversations(format_windows(rows.unionByName(extra)))
