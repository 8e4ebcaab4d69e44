"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all preceding turns are context, the reply alone is
trainable. Turns after the last assistant turn (all turns, if there is none) end in one example with
no trainable reply, so the output holds every turn of every conversation.

Template: ``<|im_start|>ROLE\\nTEXT<|im_end|>\\n`` a turn. In roles and texts each ``<``, ``[`` and
backslash is followed by a backslash, so no control string that begins with ``<`` or ``[`` (this
template's or another's) can occur in them; taking that backslash away restores the text.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
_TURN = re.compile(r"<\|im_start\|>(.*?)\n(.*?)<\|im_end\|>\n", re.S)
_ESCAPED = re.compile(r"([<\[\\])\\")


def escape(c: Column) -> Column:
    return F.regexp_replace(c, r"([<\[\\])", r"$1\\")


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def escape_role(c: Column) -> Column:
    # a line break ends the role, so it must not stand in one
    return F.replace(escape(c), F.lit("\n"), F.lit("[n"))


def unescape_role(role: str) -> str:
    return unescape(re.sub(r"\[n", "\n", role))


def parse(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a formatted example."""
    return [(unescape_role(r), unescape(t)) for r, t in _TURN.findall(formatted)]


def format_examples(turns: DataFrame) -> DataFrame:
    """(conv_id, example, n_turns, last, text, loss_start, loss_end) of all conversations.

    ``text`` is the formatted example, trainable in code points [loss_start, loss_end); both are null in
    the example without a reply. ``example`` counts from 0; ``last`` marks a conversation's last example,
    which holds all its turns.

    Edge cases: null texts and roles count as empty; turns are in order of turn (null first), ties by
    role and text; repeated rows are turns of their own; rows with a null conv_id form one conversation;
    an empty reply has an empty span; an empty table gives no rows; other columns are not read.
    """
    rows = turns.select(
        "conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    rows = rows.withColumn("head", F.concat(F.lit(OPEN), escape_role(F.col("role")), F.lit("\n"))).withColumn(
        "body", escape(F.col("text"))
    )
    # array_sort puts structs in order of turn (null first), role, text
    convs = rows.groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("turn", "role", "text", "head", "body"))).alias("turns")
    )
    n = F.size("turns")
    replies = F.filter(F.sequence(F.lit(1), n), lambda i: F.element_at("turns", i)["role"] == "assistant")
    ends = F.when(
        (F.size(replies) > 0) & (F.element_at(replies, -1) == n), replies
    ).otherwise(F.concat(replies, F.array(n)))
    rendered = F.transform("turns", lambda t: F.concat(t["head"], t["body"], F.lit(CLOSE)))
    out = convs.select("conv_id", "turns", rendered.alias("rendered"), F.posexplode(ends).alias("example", "end"), n.alias("all"))
    target = F.element_at("turns", F.col("end"))
    text = F.array_join(F.slice("rendered", F.lit(1), F.col("end")), "")
    before = F.length(F.array_join(F.slice("rendered", F.lit(1), F.col("end") - 1), "")) + F.length(target["head"])
    is_reply = target["role"] == "assistant"
    return out.select(
        "conv_id", "example", F.col("end").alias("n_turns"), (F.col("end") == F.col("all")).alias("last"),
        text.alias("text"), F.when(is_reply, before).alias("loss_start"),
        F.when(is_reply, before + F.length(target["body"])).alias("loss_end"),
    )


def read_back(examples: DataFrame) -> DataFrame:
    """What the formatted examples say, one row a conversation, read from their text and spans alone.

    conv_id, n_turns, turns_sha256 (role, \\n, text, \\n of every turn), loss_chars, loss_sha256 (the
    unescaped replies under the loss mask, in order), formatted_chars (code points of all examples).
    """
    import hashlib

    import pandas as pd

    def run(batches):
        for b in batches:
            out = []
            for conv, ex, last, text, lo, hi in zip(
                b["conv_id"], b["example"], b["last"], b["text"], b["loss_start"], b["loss_end"], strict=True
            ):
                n, sha = None, None
                if last:
                    turns = parse(text)
                    n = len(turns)
                    sha = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
                loss = None if pd.isna(lo) else unescape(text[int(lo) : int(hi)])
                out.append((conv, ex, n, sha, loss, len(text)))
            yield pd.DataFrame(out, columns=["conv_id", "example", "n_turns", "sha", "loss", "chars"]).astype(
                {"n_turns": "Int64", "conv_id": "Int64"}
            )

    got = examples.mapInPandas(
        run, "conv_id long, example int, n_turns long, sha string, loss string, chars long"
    )
    per_conv = got.groupBy("conv_id").agg(
        F.max("n_turns").alias("n_turns"), F.max("sha").alias("turns_sha256"), F.sum("chars").alias("formatted_chars"),
        F.sort_array(F.collect_list(F.when(F.col("loss").isNotNull(), F.struct("example", "loss")))).alias("losses"),
    )
    whole = F.array_join(F.transform("losses", lambda x: x["loss"]), "")
    return per_conv.select(
        "conv_id", "n_turns", "turns_sha256", F.length(whole).cast("long").alias("loss_chars"),
        F.sha2(whole, 256).alias("loss_sha256"), "formatted_chars",
    )
