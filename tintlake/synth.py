"""Occurrence relations made from the driver's lineitem table, which holds no style literals, with SQL that Spark and DuckDB read alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

COLUMNS = ("file", "ord", "line", "column", "selector", "property", "raw_value", "full_value", "category", "media_query")
#: The place of a row, from its own fields: no sort.
PLACE = "((l_orderkey * 8 + l_linenumber) * 4096 + l_partkey % 4096) * 64 + l_suppkey % 64"


def hex2(x: str, duck: bool) -> str:
    return f"printf('%02x', cast({x} as bigint))" if duck else f"lower(lpad(hex(cast({x} as bigint)), 2, '0'))"


def _rgb(r: str, g: str, b: str, duck: bool) -> str:
    return "'#' || " + " || ".join(hex2(x, duck) for x in (r, g, b))


#: Channels of the colours below.
RED, GREEN, BLUE = "(l_partkey % 12) * 20", "(l_suppkey % 10) * 25", "cast(l_quantity as bigint) % 5 * 50"


def digit(x: str) -> str:
    return f"substr('0123456789ABCDEF', cast({x} as int) + 1, 1)"


def css_color(duck: bool) -> str:
    """A colour in the notation that the line's number picks."""
    t = lambda x: f"cast({x} as {'varchar' if duck else 'string'})"
    return f"""case l_linenumber when 1 then '#' || {digit("l_partkey % 16")} || {digit("l_suppkey % 16")} || {digit("cast(l_quantity as bigint) % 16")}
        when 2 then 'rgb(' || {t(RED)} || ', ' || {t(GREEN)} || ',' || {t(BLUE)} || ')'
        when 3 then 'RGBA(' || {t(RED)} || ', ' || {t(GREEN)} || ', ' || {t(BLUE)} || ', 0.' || {t("l_partkey % 9 + 1")} || ')'
        when 4 then 'rgb(' || {t(RED)} || ' ' || {t(GREEN)} || ' ' || {t(BLUE)} || ' / ' || {t("l_partkey % 9 * 10")} || '%)'
        when 5 then 'hsl(' || {t("l_partkey % 36 * 10")} || ', ' || {t("l_suppkey % 5 * 25")} || '%, ' || {t("cast(l_quantity as bigint) % 5 * 25")} || '%)'
        when 6 then 'hwb(' || {t("l_partkey % 36 * 10")} || 'deg ' || {t("l_suppkey % 5 * 10")} || '% ' || {t("cast(l_quantity as bigint) % 5 * 10")} || '%)'
        else {_rgb(RED, GREEN, BLUE, duck)} || {hex2("l_partkey % 5 * 51", duck)} end"""


def lab_color(text: str) -> str:
    t = lambda x: f"cast({x} as {text})"
    light, a, b, hue = t("l_partkey % 11 * 10"), t("l_suppkey % 9 * 5 - 20"), t("cast(l_quantity as bigint) % 9 * 5 - 20"), t("l_partkey % 24 * 15")
    return f"""case l_linenumber % 5 when 0 then 'lab(' || {light} || ' ' || {a} || ' ' || {b} || ')' when 1 then 'lch(' || {light} || '% ' || {t("l_suppkey % 9 * 5")} || ' ' || {hue} || ')'
        when 2 then 'oklab(' || {light} || '% 0.0' || {t("l_suppkey % 9")} || ' -0.0' || {t("cast(l_quantity as bigint) % 9")} || ')'
        when 3 then 'oklch(' || {light} || '% 0.0' || {t("l_suppkey % 9")} || ' ' || {hue} || 'deg)' else 'color(display-p3 0.' || {t("l_partkey % 10")} || ' 0.' || {t("l_suppkey % 10")} || ' ' || {t("cast(l_quantity as bigint) % 5 * 20")} || '%)' end"""


def composite(duck: bool) -> str:
    """Shadows, borders and transitions, spelled in more than one way."""
    t = lambda x: f"cast({x} as {'varchar' if duck else 'string'})"
    n, own = t("l_partkey % 6"), _rgb(RED, GREEN, BLUE, duck)
    return f"""case l_linenumber when 1 then '0px ' || {n} || 'PX  4px ' || upper({own}) when 2 then '0 ' || {n} || 'px 4px rgb(' || {t(RED)} || ', ' || {t(GREEN)} || ', ' || {t(BLUE)} || ')'
        when 3 then 'inset 0 1px 2px rgba(' || {t(RED)} || ', ' || {t(GREEN)} || ', ' || {t(BLUE)} || ', 0.5)' when 4 then {t("l_partkey % 6 + 1")} || 'px SOLID ' || {own}
        when 5 then 'all ' || {t("l_partkey % 6 + 1")} || '00ms Ease-In-Out' when 6 then 'opacity .' || {t("l_partkey % 6 + 1")} || 's cubic-bezier(0.4, 0, 0.2, 1) 50ms' else 'color 1s, width ' || {n} || 's' end"""


def view(name: str, duck: bool) -> str:
    """The SELECT over lineitem that makes a view."""
    text = "varchar" if duck else "string"
    selector = f"'.s' || cast(l_partkey % 40 as {text})"
    prop, category, raw, full, media = "'color'", "'color'", "", None, f"cast(null as {text})"
    if name == "occ_color":
        prop = "case l_suppkey % 10 % 3 when 0 then 'color' when 1 then 'background-color' else 'border-color' end"
        own = _rgb("(l_partkey % 12) * 20 + l_linenumber % 2", "(l_suppkey % 10) * 25", "cast(l_quantity as bigint) % 5 * 50", duck)
        raw = f"case when l_linenumber % 4 = 3 then upper({own}) else {own} end"
    elif name == "occ_length":
        prop, category = "'padding'", "case when l_suppkey % 5 = 0 then 'radius' else 'spacing' end"
        n = "((l_partkey % 24) * 250 + case when l_orderkey % 97 = 0 then 5 else 0 end)"
        raw = f"case when l_linenumber % 2 = 0 then cast((l_partkey % 24) * 4 as {text}) || 'px' else cast(cast(floor({n} / 1000e0) as int) as {text}) || '.' || lpad(cast({n} % 1000 as {text}), 3, '0') || 'rem' end"
        full = f"'0 ' || ({raw}) || ' calc(1px + ' || ({raw}) || ')'"
    elif name == "occ_fontsize":
        prop, category = "'font-size'", "'font-size'"
        # two values that are rare, in selectors of their own
        rare = "l_orderkey = 3 and l_linenumber < 3"
        raw = f"case when {rare} then case l_linenumber when 1 then '17px' else '25px' end when l_partkey % 3 = 0 then '16px' when l_partkey % 3 = 1 then '1rem' else '24px' end"
        selector = f"case when {rare} then '.rare' else {selector} end"
        media = "case when l_linenumber = 7 then '(min-width: 768px)' end"
    elif name in ("occ_theme", "occ_contrast"):
        prop = "case when l_linestatus = 'O' then 'color' else 'background-color' end"
        raw = _rgb("(l_partkey % 12) * 20", "(l_suppkey % 10) * 25", "l_linenumber * 30", duck)
        if name == "occ_theme":
            selector = f"case when l_returnflag = 'R' and l_linenumber % 2 = 0 then '.dark ' else '' end || {selector}"
        else:
            selector = f"case when l_linenumber = 1 and l_orderkey % 40 = 0 then 'body' when l_linenumber = 5 and l_linestatus = 'O' then '.only' || cast(l_partkey % 40 as {text}) when l_linenumber % 3 = 0 then {selector} || '__t' else {selector} end"
    elif name == "occ_shadow":
        prop = "case when l_linenumber % 2 = 0 then 'box-shadow' else 'color' end"
        own = _rgb("(l_partkey % 12) * 20", "(l_suppkey % 10) * 25", "0", duck)
        layer = f"'0 ' || cast(l_partkey % 9 as {text}) || 'px ' || cast(l_partkey % 7 as {text}) || 'px ' || {own}"
        full = f"case when l_linenumber % 2 = 1 then {own} when l_linenumber % 4 = 0 then {layer} else {layer} || ', inset 1px 2px ' || {own} end"
        category = "case when l_linenumber % 2 = 0 then 'shadow' else 'color' end"
        raw = full
    elif name == "occ_font":
        prop = "case l_linenumber % 3 when 0 then 'font-size' when 1 then 'line-height' else 'font-weight' end"
        category = prop
        raw = f"case l_linenumber % 3 when 0 then cast(12 + l_partkey % 5 as {text}) || 'px' when 1 then '1.' || cast(l_partkey % 6 as {text}) else cast((1 + l_partkey % 9) * 100 as {text}) end"
    elif name == "occ_css_color":
        raw, category = css_color(duck), "'color'"
    elif name == "occ_lab":
        raw, category = lab_color(text), "'color'"
    elif name == "occ_composite":
        prop = "case when l_linenumber < 4 then 'box-shadow' when l_linenumber = 4 then 'border' else 'transition' end"
        raw, category = composite(duck), "case when l_linenumber < 4 then 'shadow' when l_linenumber = 4 then 'border' else 'transition' end"
    else:
        raise KeyError(name)
    key = f"'src/f' || cast(l_suppkey % 50 as {text}) || case when l_suppkey % 50 < 10 then '.scss' else '.css' end"
    block = ", cast(l_orderkey as bigint) as block" if name == "occ_font" else ""
    quote = '"column"' if duck else "`column`"
    return f"""select {key} as file, cast({PLACE} as bigint) as ord, cast(l_orderkey % 1000 as int) as line, cast(l_linenumber as int) as {quote},
        {selector} as selector, {prop} as property, {raw} as raw_value, {full or raw} as full_value, {category} as category, {media} as media_query{block}
        from lineitem"""


def occurrences(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    lineitem = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    sql = view(name, False).replace("from lineitem", "from {lineitem}")
    # braces of the literal table only: the rest of the text holds none
    return spark.sql(sql, lineitem=lineitem)


def css(duck: bool) -> str:
    """A stylesheet for each order: one rule for each of its lines."""
    text = "varchar" if duck else "string"
    rule = f"'.s' || cast(l_partkey % 40 as {text}) || ' ' || chr(123) || ' padding: ' || cast((l_partkey % 24) * 4 as {text}) || 'px; ' || chr(125)"
    if duck:
        return f"select l_orderkey, string_agg(r, chr(10) order by l_linenumber, r) as contents from (select l_orderkey, l_linenumber, {rule} as r from lineitem) group by l_orderkey"
    return f"select l_orderkey, listagg(r, '\\n') within group (order by l_linenumber, r) as contents from (select l_orderkey, l_linenumber, {rule} as r from {{lineitem}}) group by l_orderkey"


def sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(css(False), lineitem=spark.read.parquet(f"{sf_dir}/lineitem.parquet"))


#: A token for each of a dozen kinds of values: category, value.
LITERALS = [
    ("spacing", "4px"), ("radius", "1.5em"), ("font-weight", "400"), ("opacity", "50%"), ("transition", "200ms"), ("transition", "Ease-In"), ("transition", "cubic-bezier(0.4, 0, .2, 1)"), ("line-height", "1.5"),
    ("font-family", "'Open Sans', Arial, serif"), ("shadow", "0 1px 2px #ff0000"), ("border", "2px solid rgb(0, 255, 0)"), ("transition", "all .3s ease 50ms"),
    ("typography", "fontFamily: Arial; fontSize: 16px; fontWeight: 700; lineHeight: 1.5"), ("typography", "fontSize: 16px; lineHeight: 1.5"), ("shadow", "0 1px 2px #ff0000, inset 0 0 1px #00ff00"), ("z-index", "10"),
]


def literal_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A token for each part, its value one of LITERALS."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet").selectExpr("p_partkey", f"cast(p_partkey % {len(LITERALS)} as int) as kind")
    values = spark.createDataFrame([(i, c, v) for i, (c, v) in enumerate(LITERALS)], "kind int, category string, value string")
    made = part.join(values.hint("broadcast"), "kind")
    return made.selectExpr("p_partkey", "concat('t', p_partkey) as name", "category", "value", "p_partkey % 9 as occurrence_count", "p_partkey % 4 as file_count", "cast(null as string) as semantic_name")
