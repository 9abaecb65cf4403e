"""Operators on design files and project paths."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions import text as T


def schematic_parts(df: DataFrame, text: str) -> DataFrame:
    """Add components (lib_id, reference, value), distinct nets and sheets (name, file).

    A component's properties are looked for in the 2000 characters from its start.
    """
    starts = F.slice(F.split(text, r'(?=\(symbol\s+\(lib_id\s+")'), 2, 1 << 20)
    got = lambda b, p: F.nullif(F.regexp_extract(F.substring(b, 1, 2000), p, 1), F.lit(""))
    component = lambda b: F.struct(got(b, r'lib_id\s+"([^"]+)"').alias("lib_id"), got(b, r'\(property\s+"Reference"\s+"([^"]*)"').alias("reference"), got(b, r'\(property\s+"Value"\s+"([^"]*)"').alias("value"))
    labels = [F.regexp_extract_all(text, F.lit(rf'\({p}\s+"([^"]+)"'), F.lit(1)) for p in ("(?:net_name|label)", "global_label", "power_port")]
    sheet = r'(?s)\(sheet\s.*?\(property\s+"Sheetname"\s+"([^"]*)".*?\(property\s+"Sheetfile"\s+"([^"]*)"'
    names, files = (F.regexp_extract_all(text, F.lit(sheet), F.lit(k)) for k in (1, 2))
    return df.withColumns({"components": F.transform(starts, component), "nets": F.array_distinct(F.concat(*labels)), "sheets": F.zip_with(names, files, lambda a, b: F.struct(a.alias("name"), b.alias("file")))})


def _plural(n: Column, name: Column) -> Column:
    return F.concat(n.cast("string"), F.lit(" "), name, F.when(n > 1, "s").otherwise(""))


def description(components: str, nets: str, sheets: str) -> Column:
    """Chips (five), components by kind (six), nets (five) and sheets (four)."""
    letters = lambda c: F.regexp_extract(c["reference"], "^[A-Z]+", 0)
    ics = F.slice(F.transform(F.filter(components, lambda c: (letters(c) == "U") & (F.length(c["value"]) > 2)), lambda c: c["value"]), 1, 5)
    known = F.create_map(*[F.lit(x) for kv in R.DESIGNATORS for x in kv])
    kinds = F.filter(F.array_distinct(F.transform(components, letters)), lambda p: p != "")
    counted = F.transform(kinds, lambda p: F.struct((-F.size(F.filter(components, lambda c: letters(c) == p))).alias("n"), F.coalesce(F.element_at(known, p), p).alias("name")))
    summary = F.array_join(F.transform(F.slice(F.array_sort(counted), 1, 6), lambda c: _plural(-c["n"], c["name"])), ", ")
    part = lambda head, xs, most: F.when(F.size(xs) > 0, F.concat(F.lit(head), F.array_join(F.slice(xs, 1, most), ", ")))
    return F.concat_ws("; ", part("ICs: ", ics, 5), F.nullif(summary, F.lit("")), part("nets: ", F.array_sort(nets), 5), part("sheets: ", F.transform(sheets, lambda s: s["name"]), 4))


def header_comment(code: Column) -> Column:
    """The leading block comment without its stars, or two leading comment lines or more; else null."""
    block = F.regexp_extract(code, r"(?s)^\s*/\*(.+?)\*/", 1)
    inner = F.filter(F.transform(F.split(block, "\n"), lambda x: F.regexp_replace(x, r"^\s*\*\s?", "")), lambda x: T.strip(x) != "")
    lines = F.split(code, "\n")
    start = F.struct(F.array().cast("array<string>").alias("kept"), F.lit(False).alias("over"))

    def fold(s: Column, line: Column) -> Column:
        bare = T.strip(line)
        is_comment, blank = bare.startswith("//"), bare == ""
        words = T.strip(F.regexp_replace(bare, "^[/ ]+", ""))
        kept = F.when(s["over"], s["kept"]).when(is_comment, F.array_append(s["kept"], words)).when(blank & (F.size(s["kept"]) > 0), F.array_append(s["kept"], F.lit(""))).otherwise(s["kept"])
        return F.struct(kept.alias("kept"), (s["over"] | ~(is_comment | blank)).alias("over"))

    leading = F.aggregate(lines, start, fold)["kept"]
    by_lines = F.when(F.size(leading) >= 2, T.strip(F.array_join(leading, "\n")))
    return F.when(block != "", T.strip(F.array_join(inner, "\n"))).otherwise(by_lines)


def path_parts(path: Column) -> list[Column]:
    """board, peripheral, example, type (which kind of examples folder) and category of a path."""
    parts = F.split(path, "/")
    kinds = F.filter(parts, lambda p: p.isin(*R.EXAMPLE_FOLDERS))
    projects, examples = F.array_position(parts, "Projects"), F.coalesce(F.array_position(parts, F.get(kinds, F.lit(0))), F.lit(0))
    at = lambda k: F.get(parts, k.cast("int"))
    board = F.when(projects > 0, F.coalesce(at(projects), F.lit("unknown"))).otherwise("unknown")
    peripheral = F.when(examples > 0, F.coalesce(F.upper(at(examples)), F.lit("OTHER"))).otherwise("OTHER")
    example = F.when(examples > 0, F.array_join(F.slice(parts, examples.cast("int") + 1, F.size(parts)), "/")).otherwise(F.element_at(parts, -1))
    return [board.alias("board"), peripheral.alias("peripheral"), example.alias("example"), F.coalesce(F.get(kinds, F.lit(0)), F.lit(R.EXAMPLE_FOLDERS[0])).alias("type"), parts[0].alias("category")]


def category(path: Column, code: Column) -> Column:
    """The first category that has a signal in the path; else in the code; else general."""
    rules = tuple((s, c) for c, signals in R.EXAMPLE_CATEGORIES for s in signals)
    return F.coalesce(T.first_rule(F.lower(path), rules, None), T.first_rule(F.lower(code), rules, None), F.lit("general"))


def circuit_type(text: Column, patterns: dict[str, str]) -> Column:
    """The type with most matches; mixed where the next has six of ten or more, or none has any."""
    counted = F.array(*[F.struct(F.regexp_count(text, F.lit(p)).alias("n"), F.lit(-k).alias("k"), F.lit(name).alias("name")) for k, (name, p) in enumerate(patterns.items())])
    order = F.reverse(F.array_sort(counted))
    return F.when(order[1]["n"] >= 0.6 * order[0]["n"], "mixed").otherwise(order[0]["name"])


def designator_summary(rows: DataFrame, key: str, ref: str) -> DataFrame:
    """Of each key its references by their letters, named and counted; the six most frequent as text."""
    letters = F.regexp_extract(ref, "^[A-Z]+", 0)
    known = F.create_map(*[F.lit(x) for kv in R.DESIGNATORS for x in kv])
    named = rows.where(letters != "").select(key, F.coalesce(F.element_at(known, letters), letters).alias("name"))
    counts = named.groupBy(key, "name").agg(F.count("*").alias("n"))
    top = counts.withColumn("rn", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("n"), "name"))).where("rn <= 6")
    told = F.transform(F.array_sort(F.collect_list(F.struct("rn", _plural(F.col("n"), F.col("name")).alias("t")))), lambda x: x["t"])
    return top.groupBy(key).agg(F.array_join(told, ", ").alias("summary"))


def library_symbols(df: DataFrame, key: str, text: str) -> DataFrame:
    """A row for each DEF block of a library: its name, place and number of lines."""
    blocks = df.select(key, F.posexplode(F.regexp_extract_all(text, F.lit(r"(?s)(DEF\s+.+?ENDDEF)"), F.lit(1))).alias("place", "block"))
    return blocks.select(key, F.regexp_extract("block", r"^DEF\s+(\S+)", 1).alias("symbol"), (F.col("place") + 1).alias("place"), T.line_count("block").cast("long").alias("n_lines"))


def side_blocks(text: Column) -> Column:
    """(name, description) of the component blocks of a side file."""
    block = r"(?m)\$CMP\s+(\S+)\s*\nD\s+(.+?)$"
    names, told = (F.regexp_extract_all(text, F.lit(block), F.lit(k)) for k in (1, 2))
    return F.zip_with(names, told, lambda a, b: F.struct(a.alias("name"), T.strip(b).alias("description")))


def macro_instruction(text: Column, path: Column) -> Column:
    field = lambda name: F.nullif(F.regexp_extract(text, rf"__{name}__\s*=\s*['\"]([^'\"]+)['\"]", 1), F.lit(""))
    stem = F.regexp_replace(F.regexp_extract(path, r"([^/]+)\.[^./]+$", 1), "[_-]", " ")
    what = F.concat(F.lit("to "), F.regexp_replace(F.lower(field("Comment")), r"\.+$", ""), F.lit("."))
    # How an instruction begins.
    begin = "Write a FreeCAD Python macro"
    return F.coalesce(F.concat(F.lit(begin + " "), what), F.concat(F.lit(begin + ": "), field("Help")), F.concat(F.lit(begin + " for '"), stem, F.lit("'.")))


def top_folder(path: Column, default: str) -> Column:
    return F.when(F.contains(path, F.lit("/")), F.split(path, "/")[0]).otherwise(default)


def netlist_features(text: Column) -> Column:
    """symbol:, net: and edge: features of a netlist, with repeats."""
    symbols = F.transform(F.regexp_extract_all(text, F.lit(r"(?i)\(symbol\s+([A-Za-z0-9_+-]+)"), F.lit(1)), lambda s: F.concat(F.lit("symbol:"), s))
    net = r"(?i)\(net\s+([A-Za-z0-9_+-]+)((?:\s+[A-Za-z0-9_+-]+)*)\)"
    names, ends = (F.regexp_extract_all(text, F.lit(net), F.lit(k)) for k in (1, 2))
    nets = F.transform(names, lambda n: F.concat(F.lit("net:"), n))
    edges = F.flatten(F.zip_with(names, ends, lambda n, e: F.transform(F.filter(F.split(e, r"\s+"), lambda r: r != ""), lambda r: F.concat(F.lit("edge:"), n, F.lit("~"), r))))
    return reduce(F.concat, [symbols, nets, edges])
