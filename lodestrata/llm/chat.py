"""Chat formatting: conversations become one templated string each, with the spans a loss may see.

Only Spark expressions are used. Turn structs are collected per conversation and sorted, runs of turns by one
role are merged into a block by an array aggregation, and the blocks are concatenated:

    <|turn|>ROLE<|says|>TEXT<|more|>TEXT<|end|>

What a lambda needs of the whole conversation is computed before it and settled (``_settle``), so nothing is evaluated once for each
turn; byte positions are running sums in two steps. Time and memory are in proportion to a conversation's turns and bytes, up to
some 10^6 turns.

``<|more|>`` stands between the merged turns of one block, so that every turn can be read back. Control strings
in roles and texts (``<|``, ``<s>``, ``</s>``, ``[INST]``, ``[/INST]``) get a backslash after their first character;
strings that already look escaped get one more, which makes the escape reversible.

Defined results: rows in turn order, nulls last, ties by role and text, repeated rows kept; a null role or text is
empty; all rows without a conversation id are one conversation; an empty table gives no rows; further
columns are ignored. A conversation, of whatever length, is one row of the result and so one task's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURN, SAYS, MORE, END = "<|turn|>", "<|says|>", "<|more|>", "<|end|>"
_PLAIN = ((r"<(\\*)(\||/?s>)", "<"), (r"\[(\\*)(/?INST\])", "["))
_ESCAPED = ((r"<\\(\\*)(\||/?s>)", "<"), (r"\[\\(\\*)(/?INST\])", "["))


def escape(text: Column) -> Column:
    for pattern, first in _PLAIN:
        text = F.regexp_replace(text, pattern, first + r"\\$1$2")
    return text


def unescape(text: Column) -> Column:
    for pattern, first in _ESCAPED:
        text = F.regexp_replace(text, pattern, first + "$1$2")
    return text


def _or_empty(column: str) -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def _settle(df: DataFrame, keep: list[str], **columns: Column) -> DataFrame:
    """``keep`` and ``columns``, evaluated once a row: the optimizer doesn't move expressions across a generator."""
    return df.select(*keep, F.inline(F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))))


_STEP = 128
_SUMS = "struct<at:bigint,starts:array<bigint>>"


def _running(of: Column) -> Column:
    """The sum of an array of longs, and the sums before each of its elements; for short arrays, as it copies what it has."""
    none = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<bigint>").alias("starts")).cast(_SUMS)
    return F.aggregate(of, none, lambda a, n: F.struct((a["at"] + n).alias("at"), F.array_append(a["starts"], a["at"]).alias("starts")).cast(_SUMS))


def format_chat(turns: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """(conv_id, turn, role, text) -> (conv_id, formatted, loss_spans).

    ``loss_spans`` are (start, length) in bytes of the UTF-8 form of ``formatted``, one for each text by
    ``loss_role``; control strings lie outside every span. Escaping runs before the shuffle, and the collection is
    combined on the map side, so what reaches the reducer of a long conversation is a few large arrays.
    """
    rows = turns.select(
        "conv_id",
        F.struct(
            F.col("turn").isNull().alias("last"), "turn", escape(_or_empty("role")).alias("role"), escape(_or_empty("text")).alias("text"),
        ).alias("t"),
    )
    now = _settle(rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t")), ["conv_id"], t=F.col("t"))
    # where a block begins: the first turn, or one by another role than the turn before
    begins = F.expr("filter(sequence(0, size(t) - 1), i -> i = 0 or t[i].role <> t[i - 1].role)")
    # bytes before the text of each turn that no text has: what ends the last block and begins this one, or what stands between
    head = F.transform(
        "t",
        lambda x, i: F.when(i == 0, F.octet_length(x.role) + len(TURN + SAYS))
        .when(F.get("t", i - 1)["role"] != x.role, F.octet_length(x.role) + len(END + TURN + SAYS)).otherwise(len(MORE)).cast("bigint"),
    )
    now = _settle(now, ["conv_id", "t"], begins=begins, head=head)
    blocks = F.expr(
        "transform(begins, (b, k) -> struct(t[b].role as role,"
        " transform(slice(t, b + 1, coalesce(get(begins, k + 1), size(t)) - b), x -> x.text) as texts))"
    )
    now = _settle(now, ["conv_id", "t", "head"], blocks=blocks, sizes=F.transform("t", lambda x, i: F.get("head", i) + F.octet_length(x.text)))
    formatted = F.concat_ws("", F.transform("blocks", lambda b: F.concat(F.lit(TURN), b.role, F.lit(SAYS), F.array_join(b.texts, MORE), F.lit(END))))
    steps = F.transform(F.sequence(F.lit(0), F.floor((F.size("t") - 1) / _STEP).cast("int")), lambda k: _running(F.slice("sizes", k * _STEP + 1, F.lit(_STEP))))
    now = _settle(now, ["conv_id", "t", "head"], formatted=formatted, steps=steps)
    now = _settle(now, ["conv_id", "t", "head", "formatted", "steps"], bases=_running(F.transform("steps", lambda s: s["at"]))["starts"])
    starts = F.flatten(F.transform("steps", lambda s, k: F.transform(s["starts"], lambda at: at + F.get("bases", k))))
    now = _settle(now, ["conv_id", "t", "head", "formatted"], starts=starts)
    spans = F.transform("t", lambda x, i: F.when(x.role == F.lit(loss_role), F.struct((F.get("starts", i) + F.get("head", i)).alias("start"), F.octet_length(x.text).cast("bigint").alias("length"))))
    return now.select("conv_id", "formatted", F.filter(spans, lambda s: s.isNotNull()).alias("loss_spans"))


def read_back(formatted: DataFrame) -> DataFrame:
    """(conv_id, formatted, loss_spans) -> those and ``turns`` (role, text) and ``loss_text``, read from the output alone."""
    keep = ["conv_id", "formatted", "loss_spans"]
    now = _settle(formatted, keep, parts=F.split("formatted", r"<\|turn\|>"))
    # as a lambda's variable the bytes are one object; a column of bytes is copied whenever it is looked at
    cut = lambda raw, s: unescape(F.decode(F.substring(raw, (s.start + 1).cast("int"), s.length.cast("int")), "UTF-8"))
    loss = F.transform(F.array(F.encode("formatted", "UTF-8")), lambda raw: F.array_join(F.transform("loss_spans", lambda s: cut(raw, s)), ""))[0]
    said = F.transform(
        F.slice("parts", F.lit(2), F.size("parts") - 1),
        lambda b: F.struct(
            unescape(F.substring_index(b, SAYS, 1)).alias("role"),
            F.split(F.regexp_replace(F.substring_index(b, SAYS, -1), r"<\|end\|>$", ""), r"<\|more\|>").alias("texts"),
        ),
    )
    now = _settle(now, keep, said=said, loss_text=loss)
    turns = F.flatten(F.transform("said", lambda b: F.transform(b.texts, lambda x: F.struct(b.role.alias("role"), unescape(x).alias("text")))))
    return _settle(now, [*keep, "loss_text"], turns=turns)


def digest(read: DataFrame) -> DataFrame:
    """Counts and hashes of what ``read_back`` gives."""
    lines = F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n")))
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(lines, ""), 256).alias("turns_sha256"),
        F.char_length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )
