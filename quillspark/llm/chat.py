"""Chat formatting with a finite-state machine over roles, in DataFrame operations only.

A declarative template names, for each role, the text before and after a turn and
whether its text counts in the loss; its transition table says which role may
follow which state, and to which state it leads. Where every role leads to one state
from anywhere, the state before a turn is told by the turn before; else a fold over
the conversation's roles runs the machine. After a turn that its state does not allow
the machine goes on from the first state, by name, to which that role leads. Output are
text segments: of each turn the opening, the body and the closing, each with its loss
flag and its place, and whether the machine allowed the turn.

Control strings inside texts are escaped by one more backslash between ``<`` and
``|`` than they have, which ``unescape`` takes away again; no text can close its turn.

Defined cases: null text is empty; a null or unknown role is formatted by the
default and makes its conversation invalid; turns of equal number are ordered by
role and text; rows without conv_id are one conversation; repeated rows are repeated
turns; an empty table gives no rows; very long texts stay whole; other columns are left
out. ``assemble`` makes one value of a conversation's text, as its digest needs;
``segments`` sorts a conversation within its task, texts in rows of their own.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    before: str = "<|im_start|>{role}\n"
    after: str = "<|im_end|>\n"
    loss_roles: tuple[str, ...] = ("assistant",)
    start: str = "start"
    transitions: dict[tuple[str, str], str] = field(
        default_factory=lambda: {
            ("start", "system"): "system", ("start", "user"): "user", ("system", "user"): "user",
            ("user", "assistant"): "assistant", ("assistant", "user"): "user",
        }
    )
    final: tuple[str, ...] = ("assistant",)


CHATML = Template()


def escape(c: Column) -> Column:
    return F.regexp_replace(c, r"<(\\*)\|", r"<\\$1|")


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, r"<\\(\\*)\|", r"<$1|")


def escape_role(c: Column) -> Column:
    return F.replace(F.replace(escape(F.coalesce(c, F.lit(""))), F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A"))


def unescape_role(c: Column) -> Column:
    return unescape(F.replace(F.replace(c, F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%")))


def segments(turns: DataFrame, template: Template = CHATML, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, place, role, state, valid, opening, body, closing, loss: one row for each turn, in order of ``place``."""
    slim = turns.select(F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), F.col(role).cast("string").alias("role"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    allowed = F.array(*[F.lit(f"{a} {r}") for a, r in sorted(template.transitions)])
    known = F.coalesce(F.col("role"), F.lit(""))
    head, tail = template.before.split("{role}")
    return run_machine(slim, template).select(
        "conv_id", "place", "role", "state",
        F.array_contains(allowed, F.concat_ws(" ", "state", known)).alias("valid"),
        F.concat(F.lit(head), escape_role(F.col("role")), F.lit(tail)).alias("opening"),
        escape(F.col("text")).alias("body"), F.lit(template.after).alias("closing"),
        F.coalesce(F.col("role").isin(*template.loss_roles), F.lit(False)).alias("loss"),
        F.coalesce(_map({(s, r): t for (s, r), t in template.transitions.items()})[F.concat_ws(" ", "state", known)], F.lit("?")).isin(*template.final).alias("final"),
    )


def _map(steps: dict[tuple[str, str], str]) -> Column:
    return F.create_map(*[F.lit(x) for (s, r), t in sorted(steps.items()) for x in (f"{s} {r}", t)])


def run_machine(slim: DataFrame, template: Template) -> DataFrame:
    """The turns with their ``place`` from 1 and the ``state`` before each."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    placed = slim.select("*", F.row_number().over(order).alias("place"))
    leads: dict[str, list[str]] = {}
    for (_, r), s in sorted(template.transitions.items(), key=lambda x: x[1]):
        leads.setdefault(r, []).append(s)
    known = F.coalesce(F.col("role"), F.lit(""))
    if all(len(set(s)) == 1 for s in leads.values()):
        after = F.coalesce(F.create_map(*[F.lit(x) for r, s in leads.items() for x in (r, s[0])])[known], F.lit("?"))
        before = F.lag(after).over(order)
        return placed.select("*", F.when(F.col("place") == 1, F.lit(template.start)).otherwise(before).alias("state"))
    # Roles alone, not texts, meet in one value; the key without nulls lets both sides keep the window's partitions.
    placed = slim.select("*", F.col("conv_id").isNull().alias("k"), F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("c"))
    placed = placed.select("*", F.row_number().over(Window.partitionBy("k", "c").orderBy("turn", "role", "text")).alias("place"))
    roles = placed.groupBy("k", "c").agg(F.array_sort(F.collect_list(F.struct("place", known.alias("role")))).alias("roles"))
    step, other = _map(template.transitions), F.create_map(*[F.lit(x) for r, s in leads.items() for x in (r, s[0])])

    def walk(acc, x):
        now = acc["now"]
        then = F.coalesce(step[F.concat_ws(" ", now, x["role"])], other[x["role"]], F.lit("?"))
        return F.struct(then.alias("now"), F.concat(acc["seen"], F.array(now)).alias("seen"))

    start = F.struct(F.lit(template.start).alias("now"), F.expr("CAST(array() AS array<string>)").alias("seen"))
    states = roles.select("k", "c", F.aggregate("roles", start, walk, lambda acc: acc["seen"]).alias("states"))
    return placed.join(states, ["k", "c"]).withColumn("state", F.col("states")[F.col("place") - 1]).drop("k", "c", "states")


def assemble(parts: DataFrame, template: Template = CHATML) -> DataFrame:
    """conv_id, formatted, loss_spans (start, size in code points), valid: one row for each conversation.

    A conversation is valid if the machine allowed every turn and stands in a final state.
    """
    rows = parts.groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("place", "opening", "body", "closing", "loss"))).alias("s"),
        F.min("valid").alias("ok"), F.max_by("final", "place").alias("ended"),
    )
    size = "length(x.opening) + length(x.body) + length(x.closing)"
    spans = f"""aggregate(s, named_struct('at', 0L, 'out', CAST(array() AS array<struct<start:bigint,size:bigint>>)),
        (a, x) -> named_struct('at', a.at + {size},
            'out', if(x.loss, concat(a.out, array(named_struct('start', a.at + length(x.opening), 'size', CAST(length(x.body) AS bigint)))), a.out)), a -> a.out)"""
    return rows.select(
        "conv_id", F.expr("array_join(transform(s, x -> concat(x.opening, x.body, x.closing)), '')").alias("formatted"),
        F.expr(spans).alias("loss_spans"), (F.col("ok") & F.col("ended")).alias("valid"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, turns (role, text), loss_text: what a formatted conversation says."""
    turn = r"(?s)<\|im_start\|>(.*?)<\|im_end\|>\n"
    found = F.regexp_extract_all("formatted", F.lit(turn), F.lit(1))
    turns = F.transform(
        found, lambda x: F.struct(unescape_role(F.substring_index(x, "\n", 1)).alias("role"), unescape(_rest(x)).alias("text"))
    )
    loss = F.transform("loss_spans", lambda p: unescape(F.substring(F.col("formatted"), p["start"].cast("int") + 1, p["size"].cast("int"))))
    return formatted.select("*", turns.alias("turns"), F.array_join(loss, "").alias("loss_text"))


def _rest(x: Column) -> Column:
    """What follows the first line break."""
    return F.substring(x, F.locate("\n", x) + F.lit(1), F.length(x))
