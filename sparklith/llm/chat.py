"""Chat formatting in budgeted, turn-aligned windows, with DataFrame functions alone.

A conversation is dealt into blocks of consecutive turn numbers, so that one endless conversation is many rows. In a
block, prefix sums of the turns' tokens choose spans of whole turns that fit the budget together with the system turn
and a limited history. Each window repeats the system turn and the last turns before it under markers of their own;
only new assistant turns are targets, so every target counts once. A turn longer than the budget is a window of its own.

Template: ``<|turn|>role\\ntext<|end|>`` for a new turn, ``<|past|>...`` for a repeated one. A control string inside a
text or role gets one backslash more after its first character (``<|`` to ``<\\|``), which reading takes away again;
this holds for the markers of other common templates, too. Line ends and backslashes in roles are escaped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUDGET = 1024
HISTORY = 2
BLOCK_TURNS = 256
#: What follows the first character of a control string.
_REST = r"\||/?s>|/?INST\]|<SYS>>|</SYS>>"
ESCAPE = rf"([<\[])(\\*)(?={_REST})"
UNESCAPE = rf"([<\[])\\(\\*)(?={_REST})"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, F.lit(ESCAPE), F.lit(r"$1\\$2"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, F.lit(UNESCAPE), F.lit("$1$2"))


def _role_out(role: Column) -> Column:
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def _role_in(role: Column) -> Column:
    # In a run of backslashes each pair stands for one; one that is left over before an n makes it a line end.
    lines = F.regexp_replace(unescape(role), F.lit(r"(?<!\\)((?:\\\\)*+)\\n"), F.lit("$1\n"))
    return F.replace(lines, F.lit("\\\\"), F.lit("\\"))


def tokens(text: Column) -> Column:
    """The budget's measure: words and single marks."""
    return F.regexp_count(text, F.lit(r"\w+|[^\w\s]")) + F.lit(4)


def windows(turns: DataFrame, budget: int = BUDGET, history: int = HISTORY, block_turns: int = BLOCK_TURNS) -> DataFrame:
    """One row per window: ``conv_id, block, window, formatted, spans, tokens``; spans are code-point ranges under the loss.

    ``turns``: conv_id, turn, role, text. Rows are ordered by turn, then role and text, nulls first. Null text or role:
    empty. Null turn: before all others. Null conv_id: a conversation of its own. Repeated rows are repeated turns. An
    empty table has no windows. Other columns are not read. The system turn is the conversation's first one, if its
    role is ``system``.
    """
    base = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    none = F.expr("cast(null as struct<turn:bigint,role:string,text:string>)")
    row = F.struct("turn", "role", "text")
    base = base.withColumn("block", F.floor(F.coalesce("turn", F.lit(0)) / F.lit(block_turns)).cast("long"))
    # A turn goes to its own block; the last turns of a block, by number, go to the next one, too, as its history.
    ahead = F.pmod(F.coalesce("turn", F.lit(0)), F.lit(block_turns)) >= block_turns - history
    kinds = F.array(F.struct("block", F.lit(2).alias("kind")), F.when(ahead, F.struct((F.col("block") + 1).alias("block"), F.lit(1).alias("kind"))))
    dealt = base.select("conv_id", row.alias("t"), F.explode(F.array_compact(kinds)).alias("k")).select("conv_id", "k.block", "k.kind", "t")
    # The opening turn of a conversation of several blocks goes to all later ones; only its own text is moved for that.
    extent = base.groupBy("conv_id").agg(F.min(F.struct("turn", "role")).alias("m"), F.min("block").alias("b0"), F.max("block").alias("b1"))
    several = extent.where("b0 < b1 and m.role = 'system'").select(F.col("conv_id").alias("c"), F.col("m.turn").alias("m"), "b0")
    opening = base.where("role = 'system'").join(several, F.expr("conv_id <=> c and turn <=> m")).groupBy("c", "b0").agg(F.min(row).alias("t"))
    later = base.select("conv_id", "block").distinct().join(opening, F.expr("conv_id <=> c and block > b0")).select("conv_id", "block", F.lit(0).alias("kind"), "t")
    item = F.struct("kind", "t")
    joined = dealt.unionByName(later).groupBy("conv_id", "block").agg(F.array_sort(F.collect_list(item)).alias("r"))

    def of(kind: int) -> Column:
        return F.transform(F.filter("r", lambda x: x["kind"] == kind), lambda x: x["t"])

    joined = joined.select("conv_id", "block", of(2).alias("turns"), of(1).alias("before"), F.try_element_at(of(0), F.lit(1)).alias("head")).where(F.size("turns") > 0)
    # In a conversation's first block the opening turn stands first.
    opens = F.col("head").isNull() & (F.size("before") == 0) & (F.col("turns")[0]["role"] == "system")
    joined = joined.withColumn("head", F.when(opens, F.col("turns")[0]).when(F.col("head").isNotNull(), F.col("head")).otherwise(none))
    joined = joined.withColumn("before", F.slice("before", -F.greatest(F.least(F.size("before"), F.lit(max(history, 1))), F.lit(1)), max(history, 1)) if history else F.slice("before", 1, 0))

    # Prefix sums of tokens over past and new turns: sums[i] is what stands before turn i.
    skip = F.size("before")
    joined = joined.select("*", F.concat("before", "turns").alias("all"), skip.alias("skip"))
    sized = joined.withColumn("size", F.transform("all", lambda t: tokens(t["text"]))).withColumn("head_size", F.coalesce(tokens(F.col("head.text")), F.lit(0)))
    sums = F.aggregate("size", F.expr("array(cast(0 as int))"), lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + n)))
    sized = sized.withColumn("sums", sums)
    # starts: for each window, the position (in "all") of its first new turn; greedy over the prefix sums.
    fits = F.expr(
        f"""aggregate(sequence(skip, greatest(size(all) - 1, skip)), array(skip), (acc, i) ->
        case when i > element_at(acc, -1) and head_size + sums[i + 1] - sums[greatest(element_at(acc, -1) - {history}, 0)] > {budget}
        then concat(acc, array(i)) else acc end)"""
    )
    opened = sized.withColumn("starts", fits).select("*", F.posexplode_outer("starts").alias("window", "from"))
    until = F.coalesce(F.try_element_at("starts", F.col("window") + 2), F.size("all"))
    opened = opened.withColumn("until", until)
    # History is taken from the nearest turns backwards as far as the budget allows; the head is not repeated twice.
    past = F.expr(
        f"""filter(sequence(1, {max(history, 1)}), k -> k <= {history} and from - k >= 0
        and head_size + sums[until] - sums[greatest(from - k, 0)] <= {budget})"""
    )
    opened = opened.withColumn("kept", F.coalesce(F.array_max(past), F.lit(0)))
    first_block = F.expr("head is not null and from - kept = 0 and skip = 0 and all[0] = head")
    opened = opened.withColumn("old", F.concat(F.when(F.col("head").isNull() | first_block, F.expr("slice(all, 1, 0)")).otherwise(F.array("head")), F.expr("slice(all, from - kept + 1, kept)")))
    opened = opened.withColumn("new", F.expr("slice(all, from + 1, until - from)"))

    def shown(mark: str):  # noqa: ANN202
        return lambda t: F.concat(F.lit(mark), _role_out(t["role"]), F.lit("\n"), escape(t["text"]), F.lit("<|end|>"))

    opened = opened.withColumn("old_text", F.array_join(F.transform("old", shown("<|past|>")), "")).withColumn("parts", F.transform("new", shown("<|turn|>")))
    ends = F.aggregate("parts", F.array(F.length("old_text")), lambda acc, p: F.concat(acc, F.array(F.element_at(acc, -1) + F.length(p))))
    opened = opened.withColumn("ends", ends)
    spans = F.expr(
        """filter(transform(new, (t, i) -> named_struct('assistant', t.role = 'assistant',
        'start', ends[i] + length('<|turn|>assistant') + 1, 'end', ends[i + 1] - length('<|end|>'))), x -> x.assistant)"""
    )
    return opened.select(
        "conv_id",
        "block",
        "window",
        F.concat("old_text", F.array_join("parts", "")).alias("formatted"),
        F.transform(spans, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"))).alias("spans"),
        F.expr("head_size * cast(size(old) > kept as int) + sums[until] - sums[from - kept]").alias("tokens"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """Each window's new turns (role, text) and its texts under the loss, read from the formatted string and the spans."""
    turn = r"(?s)<\|turn\|>([^\n]*)\n(.*?)<\|end\|>"
    roles, texts = (F.regexp_extract_all("formatted", F.lit(turn), F.lit(i)) for i in (1, 2))
    under = F.transform("spans", lambda x: unescape(F.substring(F.col("formatted"), x["start"] + 1, x["end"] - x["start"])))
    return formatted.select("conv_id", "block", "window", F.length("formatted").alias("chars"), F.transform(roles, _role_in).alias("roles"), F.transform(texts, unescape).alias("texts"), under.alias("under"))


def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and conversation -7, formatted and read back: digests of turns and of the text under the loss.

    A SHA-256 runs over a conversation from its first turn to its last, so for the digests alone a conversation's
    windows come together in one row.
    """
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    say = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", say), (-7, 1, "assistant", say)], "conv_id long, turn long, role string, text string")
    back = read_back(windows(turns.unionByName(extra)))
    lines = F.array_join(F.transform(F.arrays_zip("roles", "texts"), lambda x: F.concat(x["roles"], F.lit("\n"), x["texts"], F.lit("\n"))), "")
    part = F.struct("block", "window", lines.alias("lines"), F.array_join("under", "").alias("under"))
    one = back.select("conv_id", part.alias("p"), F.size("roles").alias("n"), "chars").groupBy("conv_id")
    one = one.agg(F.sum("n").alias("n_turns"), F.sum("chars").cast("long").alias("formatted_chars"), F.array_sort(F.collect_list("p")).alias("p"))
    under = F.array_join(F.transform("p", lambda x: x["under"]), "")
    return one.select(
        "conv_id",
        F.col("n_turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("p", lambda x: x["lines"]), ""), 256).alias("turns_sha256"),
        F.length(under).cast("long").alias("loss_chars"),
        F.sha2(under, 256).alias("loss_sha256"),
        "formatted_chars",
    )
