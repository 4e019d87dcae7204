"""Chat formatting by schema fingerprints.

The layout of a record is the set of its nested field paths; the hash of the sorted paths is its fingerprint.
A registry maps fingerprints to declarative mappings, each a way to read canonical turns (role, text)
out of one layout: rows by turn, message lists, prompt and completion, instruction and input. Tables are
fingerprinted by their schema, JSON records one by one, so that one column may mix layouts.
The main path is DataFrame functions only.

Template: `### Assistant: text</turn>` and a line end per turn. Inside texts a backslash is doubled, `</turn>` becomes
`<\\/turn>` and the third of three number signs in a row gets a backslash, so that neither control string
occurs in an escaped text and dropping the backslashes restores it.

Defined results: a null text or role is the empty string; turns are in order of turn, role, text (null turns
first), repeated rows are kept; a record of an unknown layout has null turns; of extra columns those that no layout
names are ignored, and with clashing names the layout with the most fields that the table holds whole is taken;
an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliospark.llm.common import table

TURNS = "array<struct<role:string,text:string>>"


@dataclass(frozen=True)
class Mapping:
    """rows: (id, order, role, text) columns of a table with a row per turn; messages: (list, role, text) of a record with a list;
    flat: (role, paths) pairs of a record with a field per turn, where several paths of one turn are joined by blank lines and
    a turn without text is left out."""

    name: str
    rows: tuple[str, str, str, str] | None = None
    messages: tuple[str, str, str] | None = None
    flat: tuple[tuple[str, tuple[str, ...]], ...] = ()
    roles: dict[str, str] = field(default_factory=dict)

    def paths(self) -> list[str]:
        if self.rows:
            return sorted(self.rows)
        if self.messages:
            top, role, text = self.messages
            return sorted([top, f"{top}[].{role}", f"{top}[].{text}"])
        return sorted({p for _, paths in self.flat for p in paths})


MAPPINGS = (
    Mapping("turn rows", rows=("conv_id", "turn", "role", "text")),
    Mapping("messages", messages=("messages", "role", "content")),
    Mapping("from and value", messages=("conversations", "from", "value"), roles={"human": "user", "gpt": "assistant"}),
    Mapping("prompt and completion", flat=(("user", ("prompt",)), ("assistant", ("completion",)))),
    Mapping("prompt and response", flat=(("user", ("prompt",)), ("assistant", ("response",)))),
    Mapping("question and answer", flat=(("system", ("system",)), ("user", ("question",)), ("assistant", ("answer",)))),
    Mapping("instruction", flat=(("user", ("instruction", "input")), ("assistant", ("output",)))),
    Mapping("short instruction", flat=(("user", ("instruction",)), ("assistant", ("output",)))),
)


def fingerprint(paths: list[str]) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()


def schema_paths(schema: T.StructType) -> list[str]:
    def walk(kind: T.DataType, at: str) -> list[str]:
        if isinstance(kind, T.StructType):
            return [p for f in kind.fields for p in [f"{at}.{f.name}" if at else f.name, *walk(f.dataType, f"{at}.{f.name}" if at else f.name)]]
        if isinstance(kind, T.ArrayType):
            return walk(kind.elementType, f"{at}[]")
        return []

    return sorted(set(walk(schema, "")))


def select_mapping(schema: T.StructType, mappings: tuple[Mapping, ...] = MAPPINGS) -> Mapping:
    """The mapping whose fingerprint is that of the schema's paths, less the paths that no mapping names."""
    named = {p for m in mappings for p in m.paths()}
    paths = [p for p in schema_paths(schema) if p in named]
    known = {fingerprint(m.paths()): m for m in mappings}
    if fingerprint(paths) in known:
        return known[fingerprint(paths)]
    whole = [m for m in mappings if set(m.paths()) <= set(paths)]
    if not whole:
        raise ValueError(f"no mapping for the fields {paths}")
    return max(whole, key=lambda m: len(m.paths()))


def _turn(role: Column, text: Column) -> Column:
    return F.struct(F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))


def _role(role: Column, roles: dict[str, str]) -> Column:
    for known, canonical in roles.items():
        role = F.when(role == known, F.lit(canonical)).otherwise(role)
    return role


def _listed_turns(items: Column, mapping: Mapping) -> Column:
    _, role, text = mapping.messages
    return F.transform(items, lambda x: _turn(_role(x[role], mapping.roles), x[text]))


def _flat_turns(mapping: Mapping, get) -> Column:
    turns = []
    for role, paths in mapping.flat:
        text = F.array_join(F.filter(F.array(*map(get, paths)), lambda x: x.isNotNull() & (x != "")), "\n\n")
        turns.append(F.when(text != "", _turn(F.lit(role), text)))
    return F.array_compact(F.array(*turns))


def canonical_turns(df: DataFrame, id_col: str = "conv_id", mappings: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    """(id_col, turns): one row per conversation of a table in any known layout."""
    mapping = select_mapping(df.schema, mappings)
    if mapping.rows:
        key, turn, role, text = mapping.rows
        rows = F.struct(F.col(turn).alias("turn"), F.coalesce(_role(F.col(role), mapping.roles), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
        grouped = df.select(F.col(key).alias(id_col), rows.alias("row")).groupBy(id_col).agg(F.sort_array(F.collect_list("row")).alias("rows"))
        return grouped.select(id_col, F.transform("rows", lambda r: F.struct(r["role"], r["text"])).alias("turns"))
    if mapping.messages:
        turns = _listed_turns(F.col(mapping.messages[0]), mapping)
        return df.select(id_col, F.coalesce(turns, F.array().cast(TURNS)).alias("turns"))
    return df.select(id_col, _flat_turns(mapping, F.col).alias("turns"))


def json_turns(df: DataFrame, id_col: str, json_col: str, mappings: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    """(id_col, fingerprint, turns) of a column of JSON records in mixed layouts, mapped row by row.

    The fingerprint of a record is that of its field paths, less those that no mapping names, so further fields of a record or of a message
    change nothing; where it is no mapping's, the mapping with the most fields that the record holds whole is taken, as for tables. A field of a message counts
    where any message of the list has it; an empty list has no messages and so no turns. Text that is no JSON object has null turns.
    """
    own = [m for m in mappings if not m.rows]
    lists = sorted({m.messages[0] for m in own if m.messages})
    parsed = df.select(id_col, F.try_parse_json(json_col).alias("record"))
    parsed = parsed.select("*", *(F.expr(f"try_variant_get(record, '$.{x}', 'array<variant>')").alias(f"_list_{x}") for x in lists))

    def there(path: str) -> Column:
        top, inner = path.split("[].") if "[]." in path else (path, "")
        if not inner:
            return F.expr(f"variant_get(record, '$.{path}', 'variant') is not null") if top not in lists else F.col(f"_list_{top}").isNotNull()
        return F.expr(f"size(_list_{top}) = 0 or exists(_list_{top}, x -> try_variant_get(x, '$.{inner}', 'variant') is not null)")

    named = sorted({p for m in own for p in m.paths()})
    parsed = parsed.withColumn("_paths", F.array_compact(F.array(*(F.when(F.coalesce(there(p), F.lit(False)), F.lit(p)) for p in named))))
    parsed = parsed.withColumn("fingerprint", F.when(F.expr("schema_of_variant(record) like 'OBJECT%'"), F.sha2(F.array_join("_paths", "\n"), 256)))

    def turns_of(m: Mapping) -> Column:
        if m.messages:
            top, role, text = m.messages
            item = lambda key: F.expr(f"transform(_list_{top}, x -> try_variant_get(x, '$.{key}', 'string'))")
            return F.transform(F.arrays_zip(item(role).alias("role"), item(text).alias("text")), lambda x: _turn(_role(x["role"], m.roles), x["text"]))
        return _flat_turns(m, lambda p: F.expr(f"try_variant_get(record, '$.{p}', 'string')"))

    turns = F.lit(None).cast(TURNS)
    for m in sorted(own, key=lambda m: len(m.paths())):  # the last that fits is taken
        turns = F.when(F.size(F.array_except(F.array(*map(F.lit, m.paths())), F.col("_paths"))) == 0, turns_of(m)).otherwise(turns)
    for m in own:
        turns = F.when(F.col("fingerprint") == fingerprint(m.paths()), turns_of(m)).otherwise(turns)
    return parsed.select(id_col, "fingerprint", F.when(F.col("fingerprint").isNotNull(), turns).alias("turns"))


#: Roles that the template writes as names; any other is written as its UTF-8 bytes in hexadecimal.
NAMED_ROLES = {"system": "System", "user": "User", "assistant": "Assistant", "tool": "Tool"}
END = "</turn>"


def escape(text: Column) -> Column:
    text = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit(END), F.lit("<\\/turn>"))
    return F.when(F.contains(text, F.lit("###")), F.regexp_replace(text, "(?<=##)#", "\\\\#")).otherwise(text)


def unescape(text: Column) -> Column:
    return F.when(F.contains(text, F.lit("\\")), F.regexp_replace(text, "(?s)\\\\(.)", "$1")).otherwise(text)


def _header(role: Column) -> Column:
    label = F.concat(F.lit("role_"), F.hex(role))
    for name, shown in NAMED_ROLES.items():
        label = F.when(role == name, F.lit(shown)).otherwise(label)
    return F.concat(F.lit("### "), label, F.lit(": "))


def format_turns(df: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """(id_col, formatted, loss_spans): loss_spans are the (start, end) code points of the escaped assistant texts."""
    pieces = F.transform("turns", lambda t: F.struct(_header(t["role"]).alias("header"), escape(t["text"]).alias("text"), (t["role"] == "assistant").alias("loss")))
    formatted = F.array_join(F.transform("pieces", lambda p: F.concat(p["header"], p["text"], F.lit(END + "\n"))), "")

    def step(acc: Column, p: Column) -> Column:
        start = acc["at"] + F.length(p["header"])
        end = start + F.length(p["text"])
        spans = F.when(p["loss"], F.concat(acc["spans"], F.array(F.struct(start.alias("start"), end.alias("end"))))).otherwise(acc["spans"])
        return F.struct((end + len(END) + 1).alias("at"), spans.alias("spans"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))
    return df.select(id_col, pieces.alias("pieces")).select(id_col, formatted.alias("formatted"), F.aggregate("pieces", start, step)["spans"].alias("loss_spans"))


def read_back(df: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """(id_col, turns, loss_text, formatted): the turns and the text under the loss mask, from the formatted text alone."""
    label = lambda piece: F.regexp_extract(piece, "^### ([A-Za-z]+|role_[0-9A-F]*): ", 1)

    def role(piece: Column) -> Column:
        found = F.decode(F.unhex(F.substring(label(piece), 6, 1 << 30)), "utf-8")
        for name, shown in NAMED_ROLES.items():
            found = F.when(label(piece) == shown, F.lit(name)).otherwise(found)
        return found

    pieces = F.filter(F.split("formatted", F.lit(END + "\n")), lambda p: p != "")
    turns = F.transform(pieces, lambda p: F.struct(role(p).alias("role"), unescape(F.substr(p, F.length(label(p)) + F.lit(7))).alias("text")))
    loss = F.array_join(F.transform("loss_spans", lambda s: unescape(F.substr(F.col("formatted"), s["start"] + F.lit(1), s["end"] - s["start"]))), "")
    return df.select(id_col, turns.alias("turns"), loss.alias("loss_text"), "formatted")


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    text = "\\### Assistant: </turn> ok"
    made = spark.sql("select * from values (-7L, 0L, 'user'), (-7L, 1L, 'assistant') as t(conv_id, turn, role)").withColumn("text", F.lit(text))
    out = read_back(format_turns(canonical_turns(rows.select("conv_id", "turn", "role", "text").unionByName(made))))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(lines.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"), F.sha2(F.col("loss_text").cast("binary"), 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


OP1_SQL = """
with rows as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '\\### Assistant: </turn> ok' union all select -7, 1, 'assistant', '\\### Assistant: </turn> ok'
), pieces as (
  select *, replace(replace(text, '\\', '\\\\'), '</turn>', '<\\/turn>') as a from rows
)
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  cast(sum(case when role = 'assistant' then length(text) else 0 end) as bigint) as loss_chars,
  sha256(coalesce(string_agg(case when role = 'assistant' then text end, '' order by turn, role, text), '')) as loss_sha256,
  cast(sum(6 + case when role in ('system', 'user', 'assistant', 'tool') then length(role) else 5 + length(hex(role)) end
    + length(a) + coalesce(list_sum(list_transform(regexp_extract_all(a, '#+'), lambda x: greatest(length(x) - 2, 0))), 0) + 8) as bigint) as formatted_chars
from pieces group by conv_id
"""
