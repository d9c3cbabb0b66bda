"""Fill-in-middle: texts cut into prefix, middle and suffix at unit borders and put into another order between markers.

Each Arrow batch is a table of a DuckDB connection inside the task, and SQL does the whole work on it: units by
regexp_extract_all, draws from sha256, parts by list_slice and array_to_string. Python touches no row.

A document's draws are the 8-digit groups of the SHA-256 of ``seed:doc_id``, so they depend on nothing else: equal rows
get equal results, whatever the batch, the task or the order. A null id counts as the empty string, a null text as the
empty text. An empty text and one that holds a marker stay plain (their output is the text itself). A text of one unit
is cut before or after it, so parts may be empty. Texts are worked off whole; a batch holds a bounded number of bytes
(or one text). Columns besides id and text are not looked at; a table without rows gives none.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import documents, read, released

#: Units: lines with their ends.
LINES = r"[^\n]*\n|[^\n]+"

#: Markers before prefix, suffix and middle.
MARKERS = ("<P>", "<S>", "<M>")

SEED = 7

#: What one connection may hold; it has no file to spill to, as a machine's own folder is not for data.
MEMORY = "1GB"

_SETTINGS = {"threads": "1", "memory_limit": MEMORY, "temp_directory": "", "autoinstall_known_extensions": "false", "autoload_known_extensions": "false"}
_SCHEMA = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string, restored string"


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _checked(markers: tuple[str, str, str]) -> tuple[str, str, str]:
    """Markers that can be found again wherever they stand between texts that hold none: no marker begins another, and no first character comes again inside one."""
    if len(markers) != 3 or not all(markers):
        raise ValueError("there are three markers, none empty")
    firsts = {m[0] for m in markers}
    if any(a != b and b.startswith(a) for a in markers for b in markers) or len(set(markers)) < 3 or any(c in firsts for m in markers for c in m[1:]):
        raise ValueError(f"markers that can be mistaken for each other: {markers}")
    return markers


def restore_sql(output: str, form: str, markers: tuple[str, str, str] = MARKERS) -> str:
    """SQL for the text behind an output and its form: what follows the first marker is split at the second, the rest at the third."""
    p, s, m = map(_text, _checked(markers))

    def parts(first: str, second: str) -> str:
        return f"string_split(substr({output}, length({first}) + 1), {second})"

    def rest(first: str, second: str, k: int) -> str:
        return f"string_split({parts(first, second)}[2], {m})[{k}]"

    return f"""case {form} when 'psm' then {parts(p, s)}[1] || {rest(p, s, 2)} || {rest(p, s, 1)} when 'spm' then {rest(s, p, 1)} || {rest(s, p, 2)} || {parts(s, p)}[1] else {output} end"""


def infill_sql(table: str = "batch", seed: int = SEED, unit: str = LINES, markers: tuple[str, str, str] = MARKERS, infill_percent: int = 100, spm_percent: int = 50) -> str:
    """SQL over a table of doc_id and text (no null text) for the columns of _SCHEMA."""
    p, s, m = map(_text, _checked(markers))
    holds = " or ".join(f"contains(text, {x})" for x in (p, s, m))
    whole = "" if unit == LINES else ", if(array_to_string(units, '') <> text, error('units do not cover the text of document ' || coalesce(cast(doc_id as varchar), 'null')), 0) as covered"
    joined = lambda a, b: f"coalesce(array_to_string(list_slice(units, {a}, {b}), ''), '')"
    return f"""
with cut as (select doc_id, text, regexp_extract_all(text, {_text(unit)}) as units, sha256({_text(f"{seed}:")} || coalesce(cast(doc_id as varchar), '')) as h from {table}),
drawn as (select doc_id, text, units, cast(len(units) as bigint) as n, list_transform([1, 9, 17, 25], lambda i: cast('0x' || substr(h, i, 8) as bigint)) as k{whole} from cut),
placed as (select *, least(k[1] % (n + 1), k[2] % (n + 1)) as a, greatest(k[1] % (n + 1), k[2] % (n + 1)) as b,
 case when text = '' or {holds} or k[3] % 100 >= {int(infill_percent)} then 'plain' when k[4] % 100 < {int(spm_percent)} then 'spm' else 'psm' end as form from drawn),
parts as (select doc_id, text, n, form, if(form = 'plain', null, {joined("1", "a")}) as prefix, if(form = 'plain', null, {joined("a + 1", "b")}) as middle, if(form = 'plain', null, {joined("b + 1", "n")}) as suffix{', covered' if whole else ''} from placed),
done as (select *, case form when 'plain' then text when 'psm' then {p} || prefix || {s} || suffix || {m} || middle else {s} || suffix || {p} || prefix || {m} || middle end as output from parts)
select doc_id, n, form, length(prefix) as prefix_chars, length(middle) as middle_chars, output, {restore_sql("output", "form", markers)} as restored from done{' where covered = 0' if whole else ''}"""


def _by_sql(sql: str, schema: pa.Schema):
    """A function over Arrow batches: each is the table `batch` of a connection that lives as long as the task."""

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        with duckdb.connect(":memory:", config=_SETTINGS) as con:
            for b in batches:
                con.register("batch", pa.Table.from_batches([b]))
                found = con.sql(sql).to_arrow_table().cast(schema)
                con.unregister("batch")
                yield from found.to_batches()

    return run


_TYPES = {"long": pa.int64(), "string": pa.string()}


def _arrow(ddl: str) -> pa.Schema:
    return pa.schema([(name, _TYPES[kind]) for name, kind in (x.split() for x in ddl.split(", "))])


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """doc_id, n (units), form (plain, psm or spm), prefix_chars, middle_chars (null if plain), output, restored (the text again, from output and form).

    `how`: seed, unit (a pattern whose matches cover each text, else this raises), markers, infill_percent, spm_percent of :func:`infill_sql`.
    """
    return documents(docs, id_col, text_col).mapInArrow(_by_sql(infill_sql(**how), _arrow(_SCHEMA)), _SCHEMA)


def restore(outputs: DataFrame, markers: tuple[str, str, str] = MARKERS) -> DataFrame:
    """doc_id, text of rows with doc_id, form, output; markers as they were given to :func:`fill_in_middle`."""
    ddl = "doc_id long, text string"
    return outputs.select("doc_id", "form", "output").mapInArrow(_by_sql(f"select doc_id, {restore_sql('output', 'form', markers)} as text from batch", _arrow(ddl)), ddl)


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_in_middle(read(spark, sf_dir, "documents"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))


def brute(doc_id: int | None, text: str | None) -> tuple:
    """The columns of op13 for one document, character by character in plain Python."""
    import hashlib

    text = text or ""
    units = re.findall(LINES, text)
    h = hashlib.sha256(f"{SEED}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, _, h4 = (int(h[i : i + 8], 16) for i in range(0, 32, 8))
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    if not text or any(m in text for m in MARKERS):
        return doc_id, len(units), "plain", None, None, sha(text), sha(text)
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    prefix, middle, suffix = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    form = "spm" if h4 % 100 < 50 else "psm"
    out = f"<S>{suffix}<P>{prefix}<M>{middle}" if form == "spm" else f"<P>{prefix}<S>{suffix}<M>{middle}"
    return doc_id, len(units), form, len(prefix), len(middle), sha(out), sha(text)


#: Lines by their ends instead of a pattern, parts by places in the text instead of lists.
ORACLE_SQL = f"""
with d as (select doc_id, coalesce(text, '') as text, sha256('{SEED}:' || coalesce(cast(doc_id as varchar), '')) as h, string_split(coalesce(text, ''), chr(10)) as s from documents),
u as (select *, cast(len(s) - if(s[-1] = '', 1, 0) as bigint) as n, cast('0x' || h[1:8] as bigint) as h1, cast('0x' || h[9:16] as bigint) as h2, cast('0x' || h[25:32] as bigint) as h4 from d),
p as (select *, least(h1 % (n + 1), h2 % (n + 1)) as a, greatest(h1 % (n + 1), h2 % (n + 1)) as b from u),
c as (select *, length(list_aggregate(s[1:a], 'string_agg', '')) + a as x, length(list_aggregate(s[1:b], 'string_agg', '')) + b as y from p),
e as (select doc_id, text, n, case when text = '' or text like '%<P>%' or text like '%<S>%' or text like '%<M>%' then 'plain' when h4 % 100 < 50 then 'spm' else 'psm' end as form,
 least(coalesce(x, 0), length(text)) as x, least(coalesce(y, 0), length(text)) as y from c),
o as (select *, case form when 'plain' then text when 'psm' then '<P>' || left(text, x) || '<S>' || substr(text, y + 1) || '<M>' || substr(text, x + 1, y - x) else '<S>' || substr(text, y + 1) || '<P>' || left(text, x) || '<M>' || substr(text, x + 1, y - x) end as output from e)
select doc_id, n, form, if(form = 'plain', null, x) as prefix_chars, if(form = 'plain', null, y - x) as middle_chars, sha256(output) as output_sha256, sha256(text) as restored_sha256 from o"""
