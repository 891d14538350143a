"""Chat formatting with a grammar round trip, in DataFrame functions only.

    conversation = "<s>" turn* ;  turn = "[INST]" role LF text "[/INST]"  |  "[OUT]" role LF text "</s>"

The second form is for the roles whose text carries loss.  A turn is rendered as it is, and a deterministic parser
that cuts the string at control strings reads it back.  Where the recovered role or text isn't identical, or a control
string stands where the grammar has none, the turn is rendered again with its content escaped: the escape sign
becomes sign + "0" and each control string sign + a digit, which no text can contain otherwise.  The whole
conversation is parsed once more and compared with hashes of its source turns.

Defined results: null texts and roles are empty; turns are ordered by turn (null first), role, text, so repeated turns
keep their number; a null conv_id is a conversation of its own; an empty table gives no conversation; very long texts
are handled whole; other columns aren't read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    begin: str = "<s>"
    asked: tuple[str, str] = ("[INST]", "[/INST]")
    answered: tuple[str, str] = ("[OUT]", "</s>")
    loss_roles: tuple[str, ...] = ("assistant",)
    sign: str = "␛"

    @property
    def controls(self) -> tuple[str, ...]:
        return (self.begin, *self.asked, *self.answered)

    @property
    def any_control(self) -> str:
        return "|".join(f"\\Q{c}\\E" for c in self.controls)


def escape(content: Column, t: Template) -> Column:
    """Line feeds are escaped too, for roles; see escape_text."""
    return F.replace(escape_text(content, t), F.lit("\n"), F.lit(f"{t.sign}9"))


def escape_text(content: Column, t: Template) -> Column:
    out = F.replace(content, F.lit(t.sign), F.lit(f"{t.sign}0"))
    for k, control in enumerate(t.controls, 1):
        out = F.replace(out, F.lit(control), F.lit(f"{t.sign}{k}"))
    return out


def unescape(content: Column, t: Template) -> Column:
    out = F.replace(content, F.lit(f"{t.sign}9"), F.lit("\n"))
    for k, control in enumerate(t.controls, 1):
        out = F.replace(out, F.lit(f"{t.sign}{k}"), F.lit(control))
    return F.replace(out, F.lit(f"{t.sign}0"), F.lit(t.sign))


def _render(role: Column, text: Column, loss: Column, t: Template) -> Column:
    return F.concat(F.when(loss, t.answered[0]).otherwise(t.asked[0]), role, F.lit("\n"), text, F.when(loss, t.answered[1]).otherwise(t.asked[1]))


def _parse_turn(segment: Column, t: Template) -> Column:
    """A struct for a segment that ends before its closing string; ok is false where the grammar is broken."""
    opened = F.when(F.startswith(segment, F.lit(t.answered[0])), F.lit(t.answered[0])).when(F.startswith(segment, F.lit(t.asked[0])), F.lit(t.asked[0]))
    body = F.substr(segment, F.length(opened) + 1)
    role = F.substring_index(body, "\n", 1)
    text = F.substr(body, F.length(role) + 2)
    ok = opened.isNotNull() & F.contains(body, F.lit("\n")) & ~F.rlike(body, F.lit(t.any_control))
    return F.struct(F.coalesce(ok, F.lit(False)).alias("ok"), unescape(role, t).alias("role"), unescape(text, t).alias("text"), (opened == t.answered[0]).alias("loss"))


def parse(formatted: Column, t: Template) -> Column:
    """array<struct<ok, role, text, loss>>, one for each turn of a whole rendering."""
    turns = F.split(F.substr(formatted, F.lit(len(t.begin) + 1)), f"\\Q{t.asked[1]}\\E|\\Q{t.answered[1]}\\E", -1)
    return F.transform(F.slice(turns, F.lit(1), F.size(turns) - 1), lambda s: _parse_turn(s, t))


def format_conversations(conversations: DataFrame, t: Template = Template()) -> DataFrame:
    """A row for each conversation: conv_id, formatted, n_turns, loss_spans and loss_bytes (array of start and end, in
    code points and in UTF-8 bytes of `formatted`), n_escaped; fails if a conversation doesn't read back identically."""
    turns = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    turns = turns.withColumn("loss", F.col("role").isin(*t.loss_roles)).withColumn("plain", _render(F.col("role"), F.col("text"), F.col("loss"), t))
    closing = F.when(F.col("loss"), F.lit(len(t.answered[1]))).otherwise(len(t.asked[1]))
    back = _parse_turn(F.substr(F.col("plain"), F.lit(1), F.length("plain") - closing), t)
    turns = turns.withColumn("back", back)
    same = F.col("back.ok") & (F.col("back.role") == F.col("role")) & (F.col("back.text") == F.col("text"))
    shown_role, shown = (lambda c: F.when(F.col("escaped"), escape(F.col(c), t)).otherwise(F.col(c))), (lambda c: F.when(F.col("escaped"), escape_text(F.col(c), t)).otherwise(F.col(c)))
    kept = turns.select("conv_id", "turn", "role", "text", "loss", F.xxhash64("role", "text").alias("source"), (~same).alias("escaped"))
    opening, tail = F.when(F.col("loss"), t.answered[0]).otherwise(t.asked[0]), F.when(F.col("loss"), t.answered[1]).otherwise(t.asked[1])
    head = F.concat(opening, shown_role("role"), F.lit("\n"))
    sizes = {"head": F.length(head), "head_bytes": F.octet_length(head), "chars": F.length(shown("text")), "bytes": F.octet_length(shown("text")), "tail": F.length(tail)}
    kept = kept.withColumns(sizes)
    order = W.partitionBy("conv_id").orderBy("turn", "role", "text").rowsBetween(W.unboundedPreceding, W.currentRow)  # as they came, not as escaped
    placed = kept.withColumns({"nth": F.row_number().over(order), "end": F.sum(F.col("head") + F.col("chars") + F.col("tail")).over(order), "end_bytes": F.sum(F.col("head_bytes") + F.col("bytes") + F.col("tail")).over(order)})
    shift = len(t.begin)
    span = lambda end, n: F.struct((F.col(end) - F.col("tail") - F.col(n) + shift).alias("start"), (F.col(end) - F.col("tail") + shift).alias("end"))
    rows = placed.select("conv_id", F.struct("nth", F.concat(head, shown("text"), tail).alias("rendered"), "source", "loss", "escaped", span("end", "chars").alias("span"), span("end_bytes", "bytes").alias("span_bytes")).alias("t"))
    whole = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    whole = whole.select(
        "conv_id", F.concat(F.lit(t.begin), F.array_join("ts.rendered", "")).alias("formatted"), F.size("ts").cast("long").alias("n_turns"), F.col("ts.source").alias("source"),
        F.filter("ts", lambda x: x["loss"])["span"].alias("loss_spans"), F.filter("ts", lambda x: x["loss"])["span_bytes"].alias("loss_bytes"),
        F.size(F.filter("ts", lambda x: x["escaped"])).cast("long").alias("n_escaped"),
    )
    read = F.transform(parse(F.col("formatted"), t), lambda x: F.when(x["ok"], F.xxhash64(x["role"], x["text"])))
    identical = F.coalesce(read == F.col("source"), F.lit(False))
    return whole.select("conv_id", F.when(identical, F.col("formatted")).otherwise(F.raise_error(F.lit("a conversation doesn't read back identically"))).alias("formatted"), "n_turns", "loss_spans", "loss_bytes", "n_escaped")


def read_back(formatted: DataFrame, t: Template = Template()) -> DataFrame:
    """Digests of what the formatted text says: turns by the parser, loss text by the mask."""
    rows = formatted.select("conv_id", "formatted", "loss_bytes", parse(F.col("formatted"), t).alias("turns"), F.encode("formatted", "UTF-8").alias("raw"))
    told = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    masked = F.array_join(F.transform("loss_bytes", lambda s: unescape(F.decode(F.substr(F.col("raw"), (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")), "UTF-8"), t)), "")
    rows = rows.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(F.encode(told, "UTF-8"), 256).alias("turns_sha256"), masked.alias("masked"), F.length("formatted").cast("long").alias("formatted_chars"))
    return rows.select("conv_id", "n_turns", "turns_sha256", F.length("masked").cast("long").alias("loss_chars"), F.sha2(F.encode("masked", "UTF-8"), 256).alias("loss_sha256"), "formatted_chars")
