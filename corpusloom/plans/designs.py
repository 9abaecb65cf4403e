"""Queries on design files, source files and project trees."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions import structure as B
from ..functions import text as T
from ..operators import designs as D
from .corpus import q
from .registry import query, table


def _parts(spark, sf):
    return table(spark, sf, "part")


def _schematic(spark, sf):
    """A schematic for each part: two symbols, nets and a sheet, from the part's columns."""
    i = F.col("p_partkey").cast("string")
    symbol = lambda lib, ref, value: F.concat(F.lit('(symbol (lib_id "'), lib, F.lit('") (at 1 2)\n (property "Reference" "'), ref, F.lit('")\n (property "Value" "'), value, F.lit('"))\n'))
    text = F.concat(
        F.lit('(kicad_sch (version 1) (lib_symbols (symbol "x(" (pin 1)))\n'),
        symbol(F.lit("MCU:A"), F.concat(F.lit("U"), i), F.col("p_name")),
        symbol(F.lit("Device:R"), F.concat(F.lit("R"), (F.col("p_size")).cast("string")), F.lit("10k")),
        symbol(F.lit("Device:L"), F.concat(F.when(F.col("p_partkey") % 2 == 0, "LED").otherwise("FB"), i), F.lit("x")),
        F.lit('(label "NET_'), i, F.lit('") (global_label "VCC") (label "VCC")\n(sheet (at 0 0) (property "Sheetname" "S'), i, F.lit('") (property "Sheetfile" "s.kicad_sch")))'),
    )
    return _parts(spark, sf).select("p_partkey", "p_name", "p_size", text.alias("text"))


@query("SELECT event_id, 3 + length(event_type) + 5 AS closing FROM events WHERE event_id % 4 < 3 UNION ALL SELECT event_id, -1 FROM events WHERE event_id % 4 = 3")
def x38_matching_paren(spark, sf):
    """Where the bracket that opens at 0 closes; quoted brackets don't count."""
    body = F.concat(F.lit('(a "'), "event_type", F.lit('(" b'), F.when(F.col("event_id") % 4 == 3, "").otherwise(")"), F.lit(" tail"))
    return table(spark, sf, "events").select("event_id", B.closing_udf(body).alias("closing"))


@query("SELECT p_partkey, 3::bigint AS header, 6::bigint AS blocks FROM part")
def x39_top_level(spark, sf):
    """The blocks right inside a file: those of the header, and those of the body."""
    s = _schematic(spark, sf).select("p_partkey", F.explode(B.top_level_udf("text")).alias("block"))
    header = F.col("block").rlike(r"^\((version|lib_symbols|sheet)\b")
    return s.groupBy("p_partkey").agg(F.count_if(header).alias("header"), F.count_if(~header).alias("blocks"))


@query("SELECT p_partkey, false AS has_block, 0 AS code FROM part WHERE p_partkey % 5 <> 0 UNION ALL SELECT p_partkey, NULL, 2 FROM part WHERE p_partkey % 5 = 0")
def x40_strip_block(spark, sf):
    """The file without the contents of its library block; code 2 where that does not close."""
    text = F.when(F.col("p_partkey") % 5 == 0, "(kicad_sch (lib_symbols (symbol").otherwise(F.col("text"))
    s = _schematic(spark, sf).select("p_partkey", B.without_block_udf(text).alias("t"))
    return s.select("p_partkey", F.contains("t", F.lit('"x("')).alias("has_block"), F.when(F.col("t").isNull(), 2).otherwise(0).alias("code"))


@query("SELECT p_partkey, 'U' || p_partkey || '=' || p_name || ',R' || p_size || '=10k,' || CASE p_partkey % 2 WHEN 0 THEN 'LED' ELSE 'FB' END || p_partkey || '=x' AS components, 'NET_' || p_partkey || ',VCC' AS nets, 'S' || p_partkey || ':s.kicad_sch' AS sheets FROM part")
def x41_schematic_parts(spark, sf):
    """Components with reference and value, distinct nets, and sheets."""
    s = D.schematic_parts(_schematic(spark, sf), "text")
    told = F.transform("components", lambda c: F.concat(c["reference"], F.lit("="), c["value"]))
    sheets = F.transform("sheets", lambda x: F.concat(x["name"], F.lit(":"), x["file"]))
    return s.select("p_partkey", F.array_join(told, ",").alias("components"), F.array_join(F.array_sort("nets"), ",").alias("nets"), F.array_join(sheets, ",").alias("sheets"))


@query("SELECT p_partkey, CASE WHEN length(p_name) > 2 THEN 'ICs: ' || p_name || '; ' ELSE '' END || CASE p_partkey % 2 WHEN 0 THEN '1 IC, 1 LED, 1 resistor' ELSE '1 IC, 1 ferrite bead, 1 resistor' END || '; nets: NET_' || p_partkey || ', VCC; sheets: S' || p_partkey AS description FROM part")
def x42_schematic_description(spark, sf):
    """Chips, a summary of components, nets and sheets in one line."""
    s = D.schematic_parts(_schematic(spark, sf), "text")
    return s.select("p_partkey", D.description("components", "nets", "sheets").alias("description"))


@query("SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'Doc ' || doc_id || chr(10) || 'of ' || source WHEN 1 THEN 'Line ' || doc_id || chr(10) || 'next' END AS comment FROM documents")
def x43_header_comment(spark, sf):
    """The comment that a file begins with: a block, or two lines or more."""
    i = F.col("doc_id").cast("string")
    k = F.col("doc_id") % 4
    code = F.when(k == 0, F.concat(F.lit("\n/* Doc "), i, F.lit("\n * of "), "source", F.lit("\n */\nint x;"))).when(k == 1, F.concat(F.lit("// Line "), i, F.lit("\n// next\nint x; // no"))).when(k == 2, "// one only\nint x;").otherwise("int x;")
    return table(spark, sf, "documents").select("doc_id", D.header_comment(code).alias("comment"))


_KIND = "CASE p_partkey % 3 WHEN 0 THEN 'Examples' WHEN 1 THEN 'Examples_LL' ELSE 'Examples_MIX' END"


@query(f"SELECT p_partkey, 'B' || p_size AS board, upper(regexp_replace(p_brand, '[^A-Za-z0-9]', '', 'g')) AS peripheral, regexp_replace(p_brand, '[^A-Za-z0-9]', '', 'g') || '/Ex_' || p_partkey AS example, {_KIND} AS type, 'Projects' AS category FROM part WHERE p_partkey % 4 > 0 UNION ALL SELECT p_partkey, 'unknown', 'OTHER', 'Ex_' || p_partkey, 'Examples', 'misc' FROM part WHERE p_partkey % 4 = 0")
def x44_path_parts(spark, sf):
    """Board, peripheral, example, type and category from a path."""
    brand = F.regexp_replace("p_brand", "[^A-Za-z0-9]", "")
    i = F.col("p_partkey").cast("string")
    path = F.when(F.col("p_partkey") % 4 == 0, F.concat(F.lit("misc/Ex_"), i)).otherwise(F.concat(F.lit("Projects/B"), F.col("p_size").cast("string"), F.lit("/"), F.expr(_KIND), F.lit("/"), brand, F.lit("/Ex_"), i))
    return _parts(spark, sf).select("p_partkey", *D.path_parts(path))


_CATEGORY_SQL = "CASE doc_id % 6 WHEN 0 THEN 'communication-spi' WHEN 1 THEN 'display' WHEN 2 THEN 'timing' WHEN 3 THEN 'communication-serial' ELSE 'general' END"


@query(f"SELECT doc_id, {_CATEGORY_SQL} AS category FROM documents")
def x10_example_category(spark, sf):
    """The first category with a signal in the path, or else in the code."""
    k = F.col("doc_id") % 6
    path = F.when(k == 0, "Lib/SPI.begin/x.ino").when(k == 1, "a/OLED_demo.ino").otherwise("a/b.ino")
    code = F.when(k == 0, "lcd.print()").when(k == 2, "x = millis(); Serial.begin(9600)").when(k == 3, "Serial.begin(9600)").otherwise("void loop() {}")
    return table(spark, sf, "documents").select("doc_id", D.category(path, code).alias("category"))


@query("SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'nrf' WHEN 1 THEN 'stm32' WHEN 2 THEN 'rp2350' WHEN 3 THEN 'nrf-microbit' ELSE 'default-' || p_size END AS platform FROM part")
def x11_rust_platform(spark, sf):
    """The first hint in a path; else what the repository is for."""
    k = F.col("p_partkey") % 5
    path = F.when(k == 0, "boards/NRF52/main.rs").when(k == 1, "stm32f4/src.rs").when(k == 2, "x/rp235x.rs").when(k == 3, "microbit/a.rs").otherwise("src/lib.rs")
    return _parts(spark, sf).select("p_partkey", T.first_rule(F.lower(path), R.RUST_PLATFORMS, None).alias("p"), "p_size").select("p_partkey", F.coalesce("p", F.concat(F.lit("default-"), F.col("p_size").cast("string"))).alias("platform"))


_TYPE_TEXT = (
    "CASE doc_id % 14 WHEN 0 THEN 'EEPROM W25Q FRAM lcd ' WHEN 1 THEN 'OLED ST7735 header ' WHEN 2 THEN 'JST Molex EEPROM NAND ' WHEN 3 THEN 'buck LM7805 power supply ESP32' WHEN 4 THEN 'STM32 crystal NRST USART'"
    " WHEN 5 THEN 'RS485 MAX3232 level shift' WHEN 6 THEN 'thermocouple BME280 op-amp' WHEN 7 THEN 'BLDC DRV8 stepper ESD' WHEN 8 THEN 'LM386 speaker microphone' WHEN 9 THEN 'antenna balun LoRa' WHEN 10 THEN 'TVS polyfuse clamp'"
    " WHEN 11 THEN 'JST Molex RJ45' WHEN 12 THEN 'ADC I2S DAC' ELSE '' END"
)
_COUNTS = ", ".join(f"len(regexp_extract_all(t, {q(p)})) AS {k}" for k, p in R.CIRCUIT_TYPES.items())
_NAMES = list(R.CIRCUIT_TYPES)
_BEST = " ".join(f"WHEN top = {k} THEN '{k}'" for k in _NAMES)


@query(f"WITH t AS (SELECT doc_id, {_TYPE_TEXT} AS t FROM documents), c AS (SELECT doc_id, {_COUNTS} FROM t), s AS (SELECT *, greatest({', '.join(_NAMES)}) AS top, list_sort([{', '.join(_NAMES)}], 'DESC')[2] AS second FROM c) SELECT doc_id, CASE WHEN second >= 0.6 * top THEN 'mixed' {_BEST} END AS type FROM s")
def x12_circuit_type(spark, sf):
    """The type with most matches of its patterns; mixed where another comes near."""
    text = F.expr(_TYPE_TEXT)
    return table(spark, sf, "documents").select("doc_id", D.circuit_type(text, R.CIRCUIT_TYPES).alias("type"))


_PERI = "CASE " + " ".join(f"WHEN contains(lower(substr(t, 1, 600)), {q(k)}) THEN {q(v)}" for k, v in R.PERIPHERALS) + " ELSE 'misc' END"


@query(f"SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN upper(lang) ELSE {_PERI} END AS peripheral FROM (SELECT doc_id, lang, 'see ' || text AS t FROM documents) WHERE doc_id % 3 <> 0 OR lang IS NOT NULL")
def x09_provenance_first(spark, sf):
    """What provenance says of the peripheral; else the first of the list in the text."""
    d = table(spark, sf, "documents").select("doc_id", F.struct(F.when(F.col("doc_id") % 3 == 0, F.upper("lang")).alias("peripheral")).alias("_provenance"), F.concat(F.lit("see "), "text").alias("t"), "lang")
    found = F.coalesce("_provenance.peripheral", T.first_rule(F.lower(F.substring("t", 1, 600)), R.PERIPHERALS, "misc"))
    return d.where("doc_id % 3 <> 0 OR lang IS NOT NULL").select("doc_id", found.alias("peripheral"))


_LETTERS = ("R", "C", "U", "LED", "FB", "ZZ", "R", "12", "SW", "R", "K")
_NAMED = "CASE l " + " ".join(f"WHEN {q(a)} THEN {q(b)}" for a, b in R.DESIGNATORS) + " ELSE l END"


@query(f"WITH r AS (SELECT c_nationkey AS k, [{', '.join(map(q, _LETTERS))}][(c_custkey * (c_nationkey + 1)) % {len(_LETTERS)} + 1] AS l FROM customer), c AS (SELECT k, {_NAMED} AS name, count(*) AS n FROM r WHERE l <> '12' GROUP BY ALL), t AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY n DESC, name) AS rn FROM c) SELECT k, string_agg(n || ' ' || name || CASE WHEN n > 1 THEN 's' ELSE '' END, ', ' ORDER BY rn) AS summary FROM t WHERE rn <= 6 GROUP BY k")
def a26_designator_summary(spark, sf):
    """References by their letters, counted and named, the six most frequent."""
    letters = F.array(*map(F.lit, _LETTERS))
    at = (F.col("c_custkey") * (F.col("c_nationkey") + 1) % len(_LETTERS)).cast("int")
    rows = table(spark, sf, "customer").select(F.col("c_nationkey").alias("k"), F.concat(F.get(letters, at), F.col("c_custkey").cast("string")).alias("ref"))
    return D.designator_summary(rows, "k", "ref")


@query("SELECT p_partkey, 'PART_' || p_partkey AS symbol, 1 AS place, 4::bigint AS n_lines FROM part UNION ALL SELECT p_partkey, 'ALT_' || p_size, 2, 3 FROM part")
def d09_design_symbols(spark, sf):
    """A row for each symbol of a library file."""
    lib = F.concat(F.lit("EESchema\n#\nDEF PART_"), F.col("p_partkey").cast("string"), F.lit(" U 0\nF0 x\nDRAW\nENDDEF\n#\nDEF ALT_"), F.col("p_size").cast("string"), F.lit(" R\nDRAW\nENDDEF\n"))
    return D.library_symbols(_parts(spark, sf).select("p_partkey", lib.alias("text")), "p_partkey", "text")


@query("SELECT p_partkey, 'PART_' || p_partkey AS symbol, CASE WHEN p_partkey % 2 = 0 THEN 'the ' || p_type END AS description FROM part")
def j21_side_file_lookup(spark, sf):
    """A symbol's description from the block of its name in the side file."""
    i = F.col("p_partkey").cast("string")
    side = F.concat(F.lit("EESchema-DOCLIB\n$CMP OTHER\nD none\n$ENDCMP\n"), F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("$CMP PART_"), i, F.lit("\nD the "), "p_type", F.lit("\nK x\n$ENDCMP\n"))).otherwise(""))
    blocks = _parts(spark, sf).select("p_partkey", F.explode(D.side_blocks(side)).alias("b")).select("p_partkey", "b.name", "b.description")
    symbols = _parts(spark, sf).select("p_partkey", F.concat(F.lit("PART_"), i).alias("symbol"))
    return symbols.join(blocks.withColumnRenamed("name", "symbol"), ["p_partkey", "symbol"], "left").select("p_partkey", "symbol", "description")


@query("SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'own ' || p_partkey WHEN 1 THEN 'above ' || p_size END AS readme FROM part")
def j20_nearby_readme(spark, sf):
    """The README beside a file, else the one above: its first lines."""
    i, size = F.col("p_partkey").cast("string"), F.col("p_size").cast("string")
    own = F.concat(F.lit("r"), size, F.lit("/d"), i)
    files = _parts(spark, sf).select("p_partkey", own.alias("folder"))
    mine = _parts(spark, sf).where("p_partkey % 3 = 0").select(own.alias("folder"), F.concat(F.lit("own "), i).alias("readme"))
    above = _parts(spark, sf).where("p_partkey % 3 = 1").select(F.concat(F.lit("r"), size, F.lit("/"), i).alias("key"), F.concat(F.lit("above "), size).alias("above"))
    named = files.withColumn("key", F.regexp_replace("folder", "/d", "/"))
    return named.join(mine, "folder", "left").join(above, "key", "left").select("p_partkey", F.coalesce("readme", "above").alias("readme"))


_MACRO_NAME = "CASE p_partkey % 3 WHEN 0 THEN 'Write a FreeCAD Python macro to draw ' || lower(p_type) || '.' WHEN 1 THEN 'Write a FreeCAD Python macro: Use ' || p_type ELSE 'Write a FreeCAD Python macro for ''Part ' || p_partkey || '''.' END"


@query(f"SELECT p_partkey, {_MACRO_NAME} AS instruction, CASE WHEN p_partkey % 2 = 0 THEN 'Cat' || p_size ELSE 'general' END AS category FROM part")
def b20_macro_record(spark, sf):
    """A macro's instruction from its comment, else its help, else its file's name; its folder is its category."""
    k = F.col("p_partkey") % 3
    text = F.concat(F.lit("__Name__ = 'M'\n"), F.when(k == 0, F.concat(F.lit("__Comment__ = 'Draw "), "p_type", F.lit(".'\n"))).otherwise(""), F.when(k <= 1, F.concat(F.lit("__Help__ = \"Use "), "p_type", F.lit('"\n'))).otherwise(""), F.lit("import x"))
    path = F.concat(F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("Cat"), F.col("p_size").cast("string"), F.lit("/"))).otherwise(""), F.lit("Part_"), F.col("p_partkey").cast("string"), F.lit(".FCMacro"))
    return _parts(spark, sf).select("p_partkey", D.macro_instruction(text, path).alias("instruction"), D.top_folder(path, "general").alias("category"))


@query("SELECT source, domain, count(*) AS n FROM (SELECT 'symbols' AS source, 'kicad-dsl' AS domain FROM part WHERE p_size <= 25 UNION ALL SELECT 'boards', 'kicad-pcb' FROM part WHERE p_partkey % 3 = 0 UNION ALL SELECT 'macros', 'freecad' FROM part WHERE p_partkey % 4 = 1) GROUP BY 1, 2")
def b21_design_assembly(spark, sf):
    """Several trees as records of their domains, counted by source."""
    p = _parts(spark, sf)
    trees = (("symbols", "kicad-dsl", "p_size <= 25"), ("boards", "kicad-pcb", "p_partkey % 3 = 0"), ("macros", "freecad", "p_partkey % 4 = 1"))
    every = None
    for source, domain, condition in trees:
        one = p.where(condition).select(F.lit(source).alias("source"), F.lit(domain).alias("domain"), F.struct("p_partkey", "p_name").alias("record"))
        every = one if every is None else every.unionByName(one)
    return every.groupBy("source", "domain").agg(F.count("*").alias("n"))


@query("SELECT p_partkey, 'NET_' || p_partkey AS first_net, 12::bigint AS n_lines FROM part WHERE p_partkey % 7 > 0")
def b22_schematic_record(spark, sf):
    """Schematics within bounds that are no stubs, as records."""
    text = F.when(F.col("p_partkey") % 7 == 0, "(kicad_sch)").otherwise(F.col("text"))
    s = _schematic(spark, sf).withColumn("text", text).withColumn("n_lines", T.line_count("text").cast("long"))
    kept = D.schematic_parts(s.where(F.col("n_lines").between(5, 800)), "text").where(F.size("components") > 0)
    return kept.select("p_partkey", F.array_min("nets").alias("first_net"), "n_lines")


@query("WITH r AS (SELECT DISTINCT l_suppkey AS repo FROM lineitem WHERE l_returnflag = 'R'), f AS (SELECT l_suppkey AS repo, l_partkey AS file, l_linenumber FROM lineitem WHERE l_linenumber <= 2) SELECT repo, count_if(l_linenumber = 1) AS new_files, count_if(l_linenumber = 2) AS legacy_files FROM f JOIN r USING (repo) GROUP BY repo")
def b23_repository_scrape(spark, sf):
    """Files of both kinds from repositories that pass the licence gate."""
    x = table(spark, sf, "lineitem")
    accepted = x.where("l_returnflag = 'R'").select(F.col("l_suppkey").alias("repo")).distinct()
    files = x.where("l_linenumber <= 2").select(F.col("l_suppkey").alias("repo"), "l_linenumber")
    return files.join(accepted, "repo", "left_semi").groupBy("repo").agg(F.count_if(F.col("l_linenumber") == 1).alias("new_files"), F.count_if(F.col("l_linenumber") == 2).alias("legacy_files"))


@query("SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'Shows ' || p_type WHEN 1 THEN p_name ELSE 'plain ' || p_brand END AS description FROM part")
def b24_doxygen_readme(spark, sf):
    """The description of a README, else its page's title, else its text."""
    k = F.col("p_partkey") % 3
    text = F.when(k == 0, F.concat(F.lit("@page X title\n@par Description\n\nShows "), "p_type", F.lit("\n\n@par Keywords\nx"))).when(k == 1, F.concat(F.lit("/**\n  @page PG "), "p_name", F.lit("\n"))).otherwise(F.concat(F.lit(" plain "), "p_brand", F.lit("\n")))
    section = T.strip(F.regexp_extract(text, r"(?s)@par\s+(?:Example\s+)?Description\s*\n(.*?)(?:@par|\z)", 1))
    title = T.strip(F.regexp_extract(text, r"@page\s+\S+[ \t]+([^\n]+)", 1))
    return _parts(spark, sf).select("p_partkey", F.coalesce(F.nullif(section, F.lit("")), F.nullif(title, F.lit("")), T.strip(text)).alias("description"))


@query("SELECT DISTINCT p_size AS size, 'GPIO' || p_size % 4 AS peripheral FROM part WHERE p_partkey % 3 = 0")
def b25_example_directories(spark, sf):
    """Directories of examples: those that hold a Src folder."""
    i, size = F.col("p_partkey"), F.col("p_size").cast("string")
    path = F.concat(F.lit("Examples/GPIO"), (F.col("p_size") % 4).cast("string"), F.lit("/E"), size, F.when(i % 3 == 0, "/Src/main.c").otherwise("/readme.txt"))
    dirs = _parts(spark, sf).select("p_size", path.alias("path")).where(F.col("path").rlike("^Examples/[^/]+/[^/]+/Src/"))
    return dirs.select(F.col("p_size").alias("size"), F.split("path", "/")[1].alias("peripheral")).distinct()


@query("WITH b AS (SELECT p_partkey % 97 AS k, 'symbol:U' || (p_partkey % 7) AS f FROM part UNION ALL SELECT p_partkey % 97, 'net:N' || p_size FROM part UNION ALL SELECT p_partkey % 97, 'edge:N' || p_size || '~U1' FROM part UNION ALL SELECT p_partkey % 97, 'edge:N' || p_size || '~R2' FROM part) SELECT k, f AS feature, count(*) AS n FROM b GROUP BY 1, 2")
def x27_netlist_features(spark, sf):
    """Symbols, nets and their ends as a bag of features."""
    text = F.concat(F.lit("(export (symbol U"), (F.col("p_partkey") % 7).cast("string"), F.lit(") (net N"), F.col("p_size").cast("string"), F.lit(" U1 R2))"))
    rows = _parts(spark, sf).select((F.col("p_partkey") % 97).alias("k"), F.explode(D.netlist_features(text)).alias("feature"))
    return rows.groupBy("k", "feature").agg(F.count("*").alias("n"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 4 = 3 THEN 0 ELSE 1 END AS erc_clean FROM part")
def b31_error_count(spark, sf):
    """A report is clean with exit code 0 and no errors: the number before "error", or none."""
    k = F.col("p_partkey") % 4
    report = F.when(k == 0, "Checked: 0 Errors, 3 warnings").when(k == 1, "all fine").when(k == 3, "12 errors found").otherwise("0 error")
    n = F.coalesce(F.regexp_extract(report, r"(?i)(\d+)\s+error", 1).try_cast("int"), F.lit(0))
    return _parts(spark, sf).select("p_partkey", (n == 0).cast("int").alias("erc_clean"))
