"""Roles of columns, kept as metadata of the schema, and their detection."""

from __future__ import annotations

import re
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.linalg import col

ROLES = ("code", "metadata", "unit", "horizon", "dimension", "co.occurrence")
KEY = "role"


def role(df: DataFrame, column: str) -> str | None:
    return (df.schema[column].metadata or {}).get(KEY)


def reclassify(df: DataFrame, columns: Sequence[str], to: str | None) -> DataFrame:
    """Give columns a role, or take it from them."""
    if to is not None and to not in ROLES:
        raise ValueError(f"unknown role {to!r}")
    for c in columns:
        if c not in df.columns:
            raise KeyError(c)
        meta = {k: v for k, v in (df.schema[c].metadata or {}).items() if k != KEY}
        df = df.withMetadata(c, meta | ({KEY: to} if to else {}))
    return df


def define(df: DataFrame, metadata: Sequence[str] = (), codes: Sequence[str] = (), horizon: Sequence[str] = (), units: Sequence[str] = ()) -> DataFrame:
    for columns, to in ((metadata, "metadata"), (codes, "code"), (horizon, "horizon"), (units, "unit")):
        df = reclassify(df, columns, to)
    return df


def with_role(df: DataFrame, wanted: str) -> list[str]:
    return [c for c in df.columns if role(df, c) == wanted]


def find_codes(df: DataFrame) -> list[str]:
    return with_role(df, "code")


def find_metadata(df: DataFrame) -> list[str]:
    return with_role(df, "metadata")


def find_dimensions(df: DataFrame) -> list[str]:
    return with_role(df, "dimension")


def remove_metadata(df: DataFrame) -> DataFrame:
    return df.drop(*[c for c in df.columns if role(df, c) in ("metadata", "unit", "horizon")])


def find_binary(df: DataFrame, columns: Sequence[str] | None = None) -> list[str]:
    """Columns whose values, null and empty ones apart, are all 0 or 1; one pass."""
    columns = list(df.columns if columns is None else columns)
    if not columns:
        return []
    text = lambda c: F.when(F.trim(col(c).cast("string")) != "", F.trim(col(c).cast("string")))
    ok = lambda c: text(c).isin("0", "1", "0.0", "1.0", "true", "false")
    row = df.agg(*[x for c in columns for x in (F.count(text(c)), F.count(F.when(ok(c), 1)))]).first()
    return [c for k, c in enumerate(columns) if row[2 * k] and row[2 * k] == row[2 * k + 1]]


# -------------------------------------------------------------------- detection
# Words in column names that hint at a role.
UNIT_WORDS = ["user", "student", "participant", "speaker", "person", "author", "subject", "respondent", "id", "name", "who", "group", "condition", "class", "team", "player", "character", "actor", "agent"]
CONVERSATION_WORDS = [
    "group", "condition", "session", "conversation", "convo", "episode", "class", "team", "day", "week", "period", "context", "case", "trial", "horizon", "activity", "task", "problem",
    "scenario", "phase", "stage", "run", "round", "turn", "half", "play", "act", "scene", "chapter", "section",
]
OTHER_WORDS = [
    "timestamp", "timestamps", "time", "times", "date", "dates", "text", "texts", "utterance", "utterances", "message", "messages", "content", "contents", "line", "lines", "row", "rows", "index", "indices",
    "notes", "note", "score", "scores", "grade", "grades", "level", "levels", "change", "changes", "pre", "post", "confidence", "values", "value", "val", "vals", "rate", "rates", "rating", "ratings",
]

# What a column's name and number of distinct values are worth for a role, and when columns hang together.
#   base: for a fitting number of values; named: for a hinting word; few: for up to few_values of them;
#   share, most: the largest number of values, as a share of the rows and outright.
WORTH = {
    "unit": {"base": 0.3, "named": 0.5, "few": 0.2, "few_values": 200, "share": 0.8, "most": 1000},
    "conversation": {"base": 0.2, "named": 0.6, "few": 0.2, "few_values": 100, "share": 0.5, "most": 500},
}
LONG_TEXT = 100  # variance of lengths beyond which a column is text
UNIT_APART = 0.25  # taken from a unit column that splits the first one's values
PARENT = 0.15  # taken from a conversation column for each coarser one that it may lie in
PARENT_PAIRS = 2.5  # pairs for each value up to which a column lies in a coarser one
PARENT_LEAST = 0.1  # what stays of a conversation column that lies in others
SECOND = 0.5  # least score of further suggested columns
SECOND_PAIRS = 1.01  # pairs for each value from which a second conversation column crosses the first
GROUPS = (2, 8)  # numbers of values of a column that may be compared
LISTED = 5  # candidates that are listed
SURE = {"units": 0.3, "conversations": 0.2, "codes": 3, "many_codes": 5, "clear_units": 0.7}


def name_words(name: str) -> set[str]:
    return set(re.findall(r"[a-z0-9]+", re.sub(r"(?<=[a-z])(?=[A-Z])", " ", name).lower()))


def profile(df: DataFrame) -> pd.DataFrame:
    """A row a column, in one pass: ``distinct`` values that are not null or empty, ``spread`` of their lengths, whether it is ``binary``."""
    names = df.columns
    text = {c: F.when(col(c).cast("string") != "", col(c).cast("string")) for c in names}
    row = df.agg(*[x for c in names for x in (F.count_distinct(text[c]), F.var_pop(F.length(text[c])))]).first() if names else []
    table = pd.DataFrame({"column": names, "distinct": row[0::2], "spread": [x or 0.0 for x in row[1::2]]})
    table["apart"] = table.column.map(lambda c: bool(name_words(c) & set(OTHER_WORDS))).astype(bool) | (table.spread > LONG_TEXT)
    binary = set(find_binary(df, table.column[~table.apart].tolist()))
    table["binary"] = [c in binary for c in names]
    return table


def shared_pairs(df: DataFrame, columns: Sequence[str]) -> pd.DataFrame:
    """``one``, ``two``, ``both``: how many different pairs of values each two columns have, in both directions; one pass."""
    two = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    made = [F.count_distinct(F.when(col(a).isNotNull() & col(b).isNotNull(), F.struct(col(a), col(b)))) for a, b in two]
    counts = list(df.agg(*made).first()) if two else []
    half = pd.DataFrame({"one": [a for a, _ in two], "two": [b for _, b in two], "both": counts})
    return pd.concat([half, half.rename(columns={"one": "two", "two": "one"})], ignore_index=True)


def worth(table: pd.DataFrame, role_name: str, words: Sequence[str], rows: int) -> pd.Series:
    """The score of each column for a role by its name and number of values."""
    w = WORTH[role_name]
    fits = table.distinct.between(2, min(rows * w["share"], w["most"]))
    hinted = table.column.map(lambda c: bool(name_words(c) & set(words)))
    return ((w["base"] + w["named"] * hinted + w["few"] * (table.distinct <= w["few_values"])).clip(upper=1.0)).where(fits, 0.0)


def detect(df: DataFrame) -> dict:
    """Likely codes, units and conversations with scores, the distinct values of every column, suggestions, a confidence and its reason.

    Two passes over the data; what follows from them are joins of the small tables of columns and of pairs of columns.
    """
    rows = df.count()
    table = profile(df)
    if not rows:
        table["binary"] = False
    open_ = table[~table.apart & ~table.binary].reset_index(drop=True)
    open_["unit"], open_["conversation"] = worth(open_, "unit", UNIT_WORDS, rows), worth(open_, "conversation", CONVERSATION_WORDS, rows)
    # Each pair of candidates with the numbers of both sides.
    facts = open_[["column", "distinct", "unit", "conversation"]]
    pairs = shared_pairs(df, open_.column.tolist()).merge(facts, left_on="one", right_on="column").merge(facts, left_on="two", right_on="column", suffixes=("", "_of"))

    # Units: the best column, and others less if they cut its values apart.
    ranked = open_.sort_values(["unit", "distinct"], ascending=False, kind="stable")
    primary = ranked.column.iloc[0] if len(ranked) else None
    with_primary = pairs[pairs.one == primary].set_index("two").both
    own = int(ranked.distinct.iloc[0]) if len(ranked) else 0
    splits = open_.column.map(with_primary).fillna(0) > own
    open_["unit"] = (open_.unit - UNIT_APART * splits).clip(lower=0.0)

    # Conversations: a finer column is worth less for each coarser one in which its values lie.
    lies = pairs[(pairs.conversation > 0) & (pairs.distinct < pairs.distinct_of) & (pairs.both <= PARENT_PAIRS * pairs.distinct_of)]
    parents = open_.column.map(lies.groupby("two").size()).fillna(0)
    lowered = (open_.conversation - PARENT * parents).clip(lower=PARENT_LEAST)
    open_["conversation"] = lowered.where((parents > 0) & (open_.conversation > 0), open_.conversation)

    units = open_[open_.unit > 0].sort_values(["unit", "distinct"], ascending=False, kind="stable")
    conversations = open_[open_.conversation > 0].sort_values(["conversation", "distinct"], ascending=[False, True], kind="stable")

    # Suggestions: columns that each value of the first unit column fixes, coarsest first; a second conversation column that crosses the first.
    fixed = units[(units.column != primary) & (units.unit >= SECOND) & (units.column.map(with_primary) == own)].sort_values("distinct", kind="stable")
    suggested_units = [*fixed.column, primary] if primary is not None else []
    suggested_conversations = conversations.column.head(1).tolist()
    if suggested_conversations:
        first = conversations.iloc[0]
        met = conversations.column.map(pairs[pairs.one == first.column].set_index("two").both)
        crossing = conversations[(conversations.conversation >= SECOND) & (conversations.distinct > first.distinct) & (met / conversations.distinct > SECOND_PAIRS)]
        suggested_conversations += crossing.column.head(1).tolist()

    groups = {}
    for c in conversations.head(3)[conversations.head(3).distinct.between(*GROUPS)].column.head(1):
        text = col(c).cast("string")
        groups[c] = sorted(r[0] for r in df.select(text.alias("v")).where("v <> ''").distinct().collect())

    kinds = {**dict.fromkeys(table.column[table.apart], "metadata"), **dict.fromkeys(table.column[table.binary], "code")}
    for r in open_.itertuples():
        kinds[r.column] = "other" if r.unit <= 0 and r.conversation <= 0 else "unit_candidate" if r.unit >= r.conversation else "conversation_candidate"
    codes = table.column[table.binary].tolist()
    clear = {"units": len(units) > 0 and units.unit.iloc[0] >= SURE["units"], "conversations": len(conversations) > 0 and conversations.conversation.iloc[0] >= SURE["conversations"]}
    confidence = "low"
    if len(codes) >= SURE["codes"] and all(clear.values()):
        confidence = "high" if len(codes) >= SURE["many_codes"] and units.unit.iloc[0] >= SURE["clear_units"] else "medium"
    listed = lambda t, score: [{"column": c, "distinct": int(d), "score": round(float(x), 2)} for c, d, x in zip(t.column.head(LISTED), t.distinct, t[score])]
    return {
        "recommended": len(codes) >= 2,
        "confidence": confidence,
        "reason": _reason(codes, units, conversations, clear),
        "n_rows": rows,
        "n_columns": len(table),
        "codes": codes,
        "units": listed(units, "unit"),
        "conversations": listed(conversations, "conversation"),
        "groups": groups,
        "roles": {c: kinds[c] for c in table.column},
        "columns": [{"column": c, "distinct": int(d), "role": kinds[c]} for c, d in zip(table.column, table.distinct)],
        "suggested_units": suggested_units,
        "suggested_conversations": suggested_conversations,
    }


def _reason(codes: Sequence[str], units: pd.DataFrame, conversations: pd.DataFrame, clear: dict[str, bool]) -> str:
    """Why a model is or is not advised, in a sentence for each part."""
    parts = ["No column holds only 0 and 1, so that nothing can be connected." if not codes else "One column of codes alone has nothing to connect with." if len(codes) == 1 else f"{len(codes)} columns hold codes (0 or 1)."]
    for name, table in (("units", units), ("conversations", conversations)):
        if clear[name]:
            parts.append(f"{table.column.iloc[0]} ({int(table.distinct.iloc[0])} values) looks like a column of {name}.")
        elif len(codes) > 1:
            parts.append(f"No column clearly names {name}.")
    return " ".join(parts)
