"""Chat formatting: a role automaton and a declarative template.

The template is a table: per role its loss flag, and the strings that open
and close a turn. The automaton is a table too: (state, role) -> state. Both
become column expressions; no Python runs on the executors.

Control strings inside texts and roles are broken by a backslash after their
first character, and backslashes are doubled, so ``unescape`` gets the
original back and a formatted text holds control strings only where the
template put them.

Rows are ordered by (turn, role, text), nulls first. A null role or text is
the empty string. Rows without conv_id form one conversation of their own.
Unknown roles are formatted without loss and make a conversation invalid.
An empty table gives an empty result. A conversation is one output row by
its nature (its digest and formatted text are single values); rows are
gathered with map-side combine. Very long texts and conversations take time
in proportion to their length; other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    opens: str = "<|im_start|>"
    after_role: str = "\n"
    closes: str = "<|im_end|>\n"
    loss_roles: tuple[str, ...] = ("assistant",)
    # strings that must never reach the output from a text, and their escape
    escapes: dict[str, str] = field(default_factory=lambda: {
        "<|": "<\\|", "</s>": "<\\/s>", "<s>": "<\\s>", "[INST]": "[\\INST]", "[/INST]": "[\\/INST]",
        "<<SYS>>": "<\\<SYS>>", "<</SYS>>": "<\\</SYS>>"})
    start: str = "start"
    moves: dict[tuple[str, str], str] = field(default_factory=lambda: {
        ("start", "system"): "asked_system", ("start", "user"): "asked", ("asked_system", "user"): "asked",
        ("asked", "assistant"): "answered", ("answered", "user"): "asked"})
    final: tuple[str, ...] = ("answered",)


def escape(c: Column, t: Template) -> Column:
    c = F.replace(c, F.lit("\\"), F.lit("\\\\"))
    for raw, safe in t.escapes.items():
        c = F.replace(c, F.lit(raw), F.lit(safe))
    return c


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, r"(?s)\\(.)", "$1")


def escape_role(c: Column, t: Template) -> Column:
    """A role ends at the first bare line feed, so its own are escaped."""
    return F.replace(escape(c, t), F.lit("\n"), F.lit("\\\n"))


def final_state(roles: Column, t: Template) -> Column:
    """State after all roles; 'invalid' once no move fits."""
    moves = F.create_map(*[F.lit(x) for (state, role), to in t.moves.items() for x in (f"{state}\n{role}", to)])
    return F.aggregate(roles, F.lit(t.start), lambda state, role: F.coalesce(
        F.try_element_at(moves, F.concat(state, F.lit("\n"), role)), F.lit("invalid")))


def format_chat(rows: DataFrame, t: Template | None = None) -> DataFrame:
    """Per conversation: conv_id, valid, segments (text, loss), formatted."""
    t = t or Template()
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    convs = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))

    def pieces(x: Column) -> Column:
        return F.array(
            F.struct(F.concat(F.lit(t.opens), escape_role(x["role"], t), F.lit(t.after_role)).alias("text"),
                     F.lit(False).alias("loss")),
            F.struct(escape(x["text"], t).alias("text"), x["role"].isin(*t.loss_roles).alias("loss")),
            F.struct(F.lit(t.closes).alias("text"), F.lit(False).alias("loss")))
    out = convs.select(
        "conv_id", final_state(F.transform("turns", lambda x: x["role"]), t).isin(*t.final).alias("valid"),
        F.flatten(F.transform("turns", pieces)).alias("segments"))
    return out.withColumn("formatted", F.array_join(F.transform("segments", lambda s: s["text"]), ""))


def read_back(formatted: DataFrame, t: Template | None = None) -> DataFrame:
    """From the output alone: turns (role, text), loss_text, and its counts."""
    t = t or Template()
    blocks = F.split(F.substring(F.col("formatted"), len(t.opens) + 1, 2_147_483_647), _quoted(t.opens), -1)
    role = r"(?s)\A((?:[^\\\n]|\\.)*+)\n"
    turns = F.transform(blocks, lambda b: F.struct(
        unescape(F.regexp_extract(b, role, 1)).alias("role"),
        unescape(F.regexp_replace(F.regexp_replace(b, role, ""), _quoted(t.closes) + r"\z", "")).alias("text")))
    loss = F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"])), "")
    return formatted.select("conv_id", "valid", "formatted", turns.alias("turns"), loss.alias("loss_text"))


def _quoted(s: str) -> str:
    return r"\Q" + s + r"\E"


def report(rows: DataFrame, t: Template | None = None) -> DataFrame:
    back = read_back(format_chat(rows, t), t)
    whole = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(whole, 256).alias("turns_sha256"),
        F.char_length("loss_text").cast("long").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"), "valid")
