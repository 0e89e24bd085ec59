"""For each query its equivalent in DuckDB SQL, written on its own."""

from __future__ import annotations

from tintlake.synth import BLUE, GREEN, LITERALS, RED, css, css_color, view


def v(name: str) -> str:
    return f"({view(name, True)})"


def byte(text: str, at: int) -> str:
    """The number that two hex digits stand for."""
    digit = lambda i: f"(instr('0123456789abcdef', lower(substr({text}, {i}, 1))) - 1)"
    return f"({digit(at)} * 16 + {digit(at + 1)})"


def linear(x: str) -> str:
    return f"(case when {x} / 255e0 <= 0.04045e0 then {x} / 255e0 / 12.92e0 else pow(({x} / 255e0 + 0.055e0) / 1.055e0, 2.4e0) end)"


def luminance(text: str) -> str:
    return f"(0.2126e0 * {linear(byte(text, 2))} + 0.7152e0 * {linear(byte(text, 4))} + 0.0722e0 * {linear(byte(text, 6))})"


def axis(text: str, weights: tuple[float, float, float], white: float) -> str:
    t = "((" + " + ".join(f"{w}e0 * {linear(byte(text, at))}" for w, at in zip(weights, (2, 4, 6), strict=True)) + f") / {white}e0)"
    return f"(case when {t} > 0.008856e0 then cbrt({t}) else 7.787e0 * {t} + 16e0 / 116e0 end)"


def lab(text: str) -> tuple[str, str, str]:
    x, y, z = axis(text, (0.4124564, 0.3575761, 0.1804375), 0.95047), axis(text, (0.2126729, 0.7151522, 0.0721750), 1.0), axis(text, (0.0193339, 0.1191920, 0.9503041), 1.08883)
    return f"(116e0 * {y} - 16e0)", f"(500e0 * ({x} - {y}))", f"(200e0 * ({y} - {z}))"


def fnv(text: str) -> str:
    """FNV-1a of ASCII text."""
    return f"printf('%08x', list_reduce(list_prepend(2166136261::bigint, list_transform(range(1, length({text}) + 1), lambda i: ascii(substr({text}, i::int, 1))::bigint)), lambda h, c: (xor(h, c) * 16777619) & 4294967295))"


#: Distinct spellings, their clusters by lower-cased value, and the commonest spelling, the first seen on ties.
COLOR_CLUSTERS = f"""occ as ({v("occ_color")}),
    spelled as (select raw_value, lower(raw_value) as k, count(*) as n, min(struct_pack(f := file, o := ord)) as first from occ group by all),
    groups as (select 'color' as category, k as cluster_key, sum(n)::bigint as n, min(first) as first, list(raw_value order by first) as members,
        first(raw_value order by n desc, first) as canonical_value from spelled group by k)"""
LENGTH_CLUSTERS = f"""occ as ({v("occ_length")}),
    groups as (select category, raw_value as canonical_value, count(*) as n, min(struct_pack(f := file, o := ord)) as first,
        case when raw_value like '%rem' then replace(raw_value, 'rem', '')::double else replace(raw_value, 'px', '')::double / 16e0 end as rem from occ group by all)"""
PX = "(case when {0} like '%rem' then replace({0}, 'rem', '')::double * 16e0 else replace({0}, 'px', '')::double end)"


def js(x: str) -> str:
    """A double without a needless fraction."""
    return f"(case when {x} = floor({x}) then ({x})::bigint::varchar else ({x})::varchar end)"


HSL = f"""rgb as (select distinct lower(raw_value) as value, {byte("raw_value", 2)} / 255e0 as r, {byte("raw_value", 4)} / 255e0 as g, {byte("raw_value", 6)} / 255e0 as b from {v("occ_color")}),
    span as (select *, greatest(r, g, b) as hi, least(r, g, b) as lo from rgb),
    hsl as (select value, (hi + lo) / 2 * 100 as l, case when hi = lo then 0 when (hi + lo) / 2 > 0.5e0 then (hi - lo) / (2 - hi - lo) * 100 else (hi - lo) / (hi + lo) * 100 end as s,
        case when hi = lo then 0 when hi = r then 60 * ((g - b) / (hi - lo) + case when g < b then 6 else 0 end) when hi = g then 60 * ((b - r) / (hi - lo) + 2) else 60 * ((r - g) / (hi - lo) + 4) end as h from span),
    named as (select value, 'color-' || case when s < 8 then 'gray' when h <= 15 then 'red' when h <= 45 then 'orange' when h <= 70 then 'yellow' when h <= 160 then 'green' when h <= 190 then 'teal'
        when h <= 250 then 'blue' when h <= 290 then 'purple' when h <= 345 then 'pink' else 'red' end || '-' || case when l > 95 then '50' when l > 90 then '100' when l > 80 then '200' when l > 70 then '300'
        when l > 60 then '400' when l > 50 then '500' when l > 40 then '600' when l > 30 then '700' when l > 20 then '800' when l > 10 then '900' else '950' end as name from hsl)"""
COLOR_NAMES = f"""{COLOR_CLUSTERS}, {HSL},
    ranked as (select g.*, name as base, row_number() over (partition by name order by n desc, first) as nth from groups g join named on value = cluster_key),
    files as (select lower(raw_value) as cluster_key, count(distinct file) as files from occ group by 1),
    tokens as (select category, cluster_key, canonical_value as value, n as occurrence_count, files as file_count, {fnv("'color::' || canonical_value")} as cluster_id,
        case when nth = 1 then base else base || '-alt' || nth end as name from ranked join files using (cluster_key))"""
NEAR_COLORS = f"""{COLOR_CLUSTERS}, labs as (select cluster_key, canonical_value, {lab("cluster_key")[0]} as l, {lab("cluster_key")[1]} as a, {lab("cluster_key")[2]} as b from groups),
    near as (select x.cluster_key as p, y.cluster_key as q, sqrt(pow(x.l - y.l, 2) + pow(x.a - y.a, 2) + pow(x.b - y.b, 2)) as d from labs x join labs y on x.cluster_key <> y.cluster_key
        where sqrt(pow(x.l - y.l, 2) + pow(x.a - y.a, 2) + pow(x.b - y.b, 2)) <= 2e0)"""
NEAR_LENGTHS = f"""{LENGTH_CLUSTERS}, ids as (select *, {fnv("category || '::' || canonical_value")} as id, category || '::' || canonical_value as k from groups),
    near as (select x.k as p, y.k as q, x.category, x.canonical_value, y.id as other, abs(x.rem - y.rem) as d from ids x join ids y on x.k <> y.k where abs(x.rem - y.rem) > 0 and abs(x.rem - y.rem) <= 0.01e0)"""
RATIO = f"(greatest({luminance('fg')}, {luminance('bg')}) + 0.05e0) / (least({luminance('fg')}, {luminance('bg')}) + 0.05e0)"
CONTRAST = f"""occ as ({v("occ_contrast")}), fgs as (select * from occ where property = 'color'), bgs as (select * from occ where property = 'background-color'),
    first_fg as (select file, selector, min(struct_pack(o := ord, l := line, v := raw_value)) as x from fgs group by all), first_bg as (select file, selector, min(struct_pack(o := ord, l := line, v := raw_value)) as x from bgs group by all),
    same as (select f.file, f.selector, f.x.l as line, f.x.o as o, f.x.v as fg, b.x.v as bg from first_fg f join first_bg b using (file, selector)),
    lonely as (select * from fgs f where not exists (from bgs b where b.file = f.file and b.selector = f.selector)),
    up as (select f.file, f.selector, f.line, f.ord as o, f.raw_value as fg, b.raw_value as bg from lonely f join bgs b on f.file = b.file and f.selector <> b.selector
        and (starts_with(f.selector, b.selector || ' ') or starts_with(f.selector, b.selector || '>') or starts_with(f.selector, b.selector || '__') or starts_with(f.selector, b.selector || '--'))),
    doc as (select f.file, f.selector, f.line, f.ord as o, f.raw_value as fg, b.raw_value as bg from lonely f join bgs b on f.file = b.file and b.selector in ('html', 'body', ':root', '(root)')
        where not exists (from up where up.file = f.file and up.selector = f.selector)),
    down as (select f.file, f.selector, f.line, f.ord as o, f.raw_value as fg, b.x.v as bg from first_bg b join fgs f on f.file = b.file and f.selector <> b.selector
        and (starts_with(b.selector, f.selector || ' ') or starts_with(b.selector, f.selector || '>') or starts_with(b.selector, f.selector || '__') or starts_with(b.selector, f.selector || '--'))
        where not exists (from fgs g where g.file = b.file and g.selector = b.selector)),
    found as (select file, selector, fg, bg, pairing, first(line order by o) as line, {RATIO} as raw from
        (select *, 'same-selector' as pairing from same union all select *, 'ancestor' from up union all select *, 'document' from doc union all select *, 'inherited' from down) group by file, selector, fg, bg, pairing)"""
FINDING = "select selector, file, line, fg as foreground, bg as background, floor(raw * 100e0 + 0.5e0) / 100e0 as ratio, raw >= 4.5e0 as passes_aa, raw >= 7e0 as passes_aaa, pairing from found"
SHADOW = f"occ as ({v('occ_shadow')})"
SHEETS = f"({css(True)})"
FONT_PX = "case when raw_value like '%rem' then replace(raw_value, 'rem', '')::double * 16e0 else replace(raw_value, 'px', '')::double end"
CSS_COLORS = "aqua #00ffff black #000000 blue #0000ff fuchsia #ff00ff gray #808080 green #008000 lime #00ff00 maroon #800000 navy #000080 olive #808000 orange #ffa500 purple #800080 red #ff0000 silver #c0c0c0 teal #008080 white #ffffff yellow #ffff00".split()
PALETTE = ", ".join(f"({i // 2}, '{CSS_COLORS[i]}', '{CSS_COLORS[i + 1]}')" for i in range(0, len(CSS_COLORS), 2))

ORACLE_SQL: dict[str, str] = {
    "report_summary": f"""with occ as ({v("occ_color")}), every(category) as (select unnest(['color', 'spacing', 'radius', 'font-family', 'font-size', 'font-weight', 'line-height', 'letter-spacing', 'shadow', 'z-index', 'breakpoint', 'transition', 'opacity', 'border', 'typography']))
        select category, count(raw_value) as total, count(distinct raw_value) as distinct_values from every left join occ using (category) group by category""",
    "report_totals": f"select count(distinct file) as files, count(*) as occurrences from {v('occ_color')}",
    "exact_cluster": f"select category, lower(raw_value) as cluster_key, count(*) as n from {v('occ_color')} group by all",
    "canonical_value": f"with {COLOR_CLUSTERS} select cluster_key, canonical_value from groups",
    "member_values": f"with {COLOR_CLUSTERS} select cluster_key, array_to_string(members, ',') as members from groups",
    "min_occurrence_gate": f"with {COLOR_CLUSTERS} select n < 30 as below_threshold, count(*) as clusters_n, sum(n)::bigint as n from groups group by 1",
    "cluster_file_count": f"select category, lower(raw_value) as cluster_key, count(distinct file) as files from {v('occ_color')} group by all",
    "normalize_color_key": f"select distinct raw_value, lower(raw_value) as color_key from {v('occ_color')}",
    "parse_hex": f"select distinct raw_value, {byte('raw_value', 2)}::double as r, {byte('raw_value', 4)}::double as g, {byte('raw_value', 6)}::double as b, 1e0 as a from {v('occ_color')}",
    "to_lab": f"select distinct lower(raw_value) as value, " + ", ".join(f"round({x}, 6) as lab_{k}" for k, x in zip("lab", lab("raw_value"), strict=True)) + f" from {v('occ_color')}",
    "relative_luminance": f"select distinct lower(raw_value) as value, round({luminance('raw_value')}, 6) as luminance from {v('occ_color')}",
    "hue_lightness_name": f"with {HSL} select value, name from named",
    "color_neighbors": f"with {NEAR_COLORS} select p as value_a, q as value_b, round(d, 6) as distance from near where p < q",
    "color_flags": f"with {NEAR_COLORS} select cluster_key, count(p) > 0 as requires_approval, round(coalesce(min(1 - d / 4e0), 1e0), 6) as confidence, count(p) as related_n from groups left join near on p = cluster_key group by cluster_key",
    "spacing_neighbors": f"with {NEAR_LENGTHS} select p as value_a, q as value_b, round(d, 6) as distance from near where p < q",
    "spacing_scale": f"""with {LENGTH_CLUSTERS}, spaced as (select rem from groups where category = 'spacing'),
        steps(i, step) as (values (0, 0.25e0), (1, 0.5e0), (2, 0.125e0)),
        tried as (select i, step, count(*) filter (where rem % step < 0.02e0 or step - rem % step < 0.02e0) as matched, count(*) as values_n from steps, spaced group by all)
        select step as step_rem, matched, values_n from tried where values_n >= 3 and matched >= values_n * 0.6e0 qualify row_number() over (order by matched desc, i) = 1""",
    "link_related_ids": f"with {NEAR_LENGTHS} select category, canonical_value, 0.9e0 as confidence, string_agg(distinct other, ',' order by other) as related from near group by all",
    "workspace_counts": f"select category, lower(raw_value) as value, count(*) as n from {v('occ_length')} group by all",
    "stable_id": f"select distinct category, raw_value, {fnv('category || chr(58) || chr(58) || raw_value')} as id from {v('occ_length')}",
    "split_css_number": f"""select distinct raw_value, regexp_extract(raw_value, '^[0-9.]+')::double as amount, regexp_extract(raw_value, '[a-z]+$') as unit,
        case when raw_value like '%rem' then replace(raw_value, 'rem', '')::double else replace(raw_value, 'px', '')::double / 16e0 end as rem, 'px' as kind, {PX.format("raw_value")} as pixels from {v("occ_length")}""",
    "match_length": f"""with found as (select distinct full_value, regexp_extract_all(full_value, '-?[0-9]*[.]?[0-9]+(?:px|rem|em|%|vh|vw|ch|ex|pt|pc|in|cm|mm|fr)') as m from {v("occ_length")})
        select full_value, unnest(range(0, len(m)))::bigint as place, unnest(m) as literal from found""",
    "match_color": f"""with found as (select distinct full_value, regexp_extract_all(full_value, '#[0-9a-fA-F]{{3,8}}') as m from {v("occ_shadow")})
        select full_value, unnest(range(0, len(m)))::bigint as place, unnest(m) as literal from found""",
    "classify_property": " union all ".join(f"select property from {v(x)}" for x in ("occ_color", "occ_length", "occ_fontsize", "occ_shadow", "occ_font")).join(("select property, count(*) as n, case property when 'padding' then 'spacing' when 'box-shadow' then 'shadow' when 'color' then 'unknown' when 'background-color' then 'unknown' when 'border-color' then 'unknown' else property end as category from (", ") group by property")),
    "drop_layout_pct": "select l_quantity::int::varchar || '%' as value, count(*) as n from lineitem where l_quantity::int not in (0, 50, 100) group by 1",
    "escape_hatch_z": "select (o_orderkey % 10000)::varchar as value, count(*) as n from orders where regexp_full_match((o_orderkey % 10000)::varchar, '9{3,}') group by 1",
    "name_category": f"select distinct category, raw_value, case category when 'spacing' then 'space-' else 'radius-' end || {js(PX.format('raw_value'))} as name from {v('occ_length')}",
    "name_case": f"""with base as (select distinct case category when 'spacing' then 'space-' else 'radius-' end || {js(PX.format("raw_value"))} as name from {v("occ_length")})
        select name, replace(name, '-', '') as camel, upper(substr(name, 1, 1)) || replace(substr(name, 2), '-', '') as pascal, replace(name, '-', '_') as snake from base""",
    "semantic_vote": f"""with roles as (select 'color' as category, lower(raw_value) as cluster_key, case property when 'color' then 'text' when 'background-color' then 'background' else 'border' end as role, substr(selector, 2) as sel, file, ord from {v("occ_color")}),
        counted as (select category, cluster_key, role, 'color-' || role || '-' || sel as name, count(*) as n, min(struct_pack(f := file, o := ord)) as first from roles group by all)
        select category, cluster_key, first(name order by n desc, first) as semantic_name from counted group by all having count(distinct role) = 1""",
    "name_collisions": f"with {COLOR_NAMES} select cluster_key, name from tokens",
    "typo_groups": f"""with g as (select category, 'px' as kind, {FONT_PX} as amount, raw_value, file, ord from {v("occ_fontsize")})
        select category, kind, amount, first(raw_value order by struct_pack(f := file, o := ord)) as display, count(*) as n from g group by category, kind, amount""",
    "typo_detect": f"""with rows as (select *, {FONT_PX} as amount from {v("occ_fontsize")}),
        g as (select amount, first(raw_value order by struct_pack(f := file, o := ord)) as display, count(*) as n, min(struct_pack(f := file, o := ord)) as first from rows group by amount),
        near as (select x.amount, x.n, x.display, y.amount as o, y.n as on_, y.display as od, y.first as of_, abs(x.amount - y.amount) as d from g x join g y on x.amount <> y.amount and abs(x.amount - y.amount) <= 2e0),
        over as (select distinct near.amount from near join rows a on a.amount = near.amount join rows b on b.amount = near.o and a.selector = b.selector and a.media_query is distinct from b.media_query),
        best as (select amount, first(on_ order by on_ desc, d, of_) as on_, first(od order by on_ desc, d, of_) as od, first(d order by on_ desc, d, of_) as d from near group by amount),
        std as (select amount, s, abs(amount - s) as d from g, (select unnest([12, 14, 16, 18, 20, 24, 32, 36, 48])::double as s) where abs(amount - s) > 0 and abs(amount - s) <= 2e0 qualify row_number() over (partition by amount order by abs(amount - s), s) = 1),
        t as (select g.*, best.on_, best.od, best.d as bd, std.s, std.d as sd, coalesce(g.n <= 2 and best.on_ >= 3 and best.on_ >= g.n * 3, false) as freq, std.s is not null and g.n <= 2 as stdhit
            from g left join best using (amount) left join std using (amount) where amount not in (select amount from over))
        select 'font-size' as category, t.display as suspect_value, t.n as suspect_count, case when freq then od else coalesce(k.display, s::int::varchar || 'px') end as likely_intended,
            case when freq then on_ else coalesce(k.n, 0) end as likely_count, round(case when freq then bd else sd end, 3) as distance, case when freq and stdhit then 'both' when freq then 'frequency' else 'standard-value' end as reason
        from t left join g k on k.amount = t.s where freq or stdhit""",
    "theme_pairs": f"""with occ as (select *, starts_with(selector, '.dark ') as dark, replace(selector, '.dark ', '') as base from {v("occ_theme")}),
        met as (select d.property, d.base, d.file as dark_file, d.ord as dark_ord, d.raw_value as dark_value, l.file as light_file, l.ord as light_ord, l.raw_value as light_value, abs(l.line - d.line) as gap,
            l.file = d.file and abs(l.line - d.line) <= 80 as nearby from occ d join occ l on d.property = l.property and d.base = l.base where d.dark and not l.dark),
        best as (select *, count(*) over (partition by dark_file, dark_ord) as candidate_count from met qualify row_number() over (partition by dark_file, dark_ord order by nearby desc, gap, light_file, light_ord) = 1)
        select property, base as base_selector, light_value, dark_value, light_file, light_ord, dark_file, dark_ord, case when candidate_count = 1 then 'high' else 'low' end as confidence, candidate_count from best where light_value <> dark_value""",
    **{name: f"with {CONTRAST} {FINDING} where pairing = '{kind}'" for name, kind in (("contrast_same", "same-selector"), ("contrast_ancestor", "ancestor"), ("contrast_document", "document"), ("contrast_inherited", "inherited"))},
    "contrast_summary": f"with {CONTRAST} select count(*) as total, count(*) filter (where pairing = 'same-selector') as same_selector, count(*) filter (where pairing = 'ancestor') as ancestor, count(*) filter (where raw < 4.5e0) as failing_aa from found",
    # the value stands twice in what it is cut from, unless it is the 0 or 1 of another literal
    "rewrite_safety": f"select distinct raw_value, full_value, case when len(regexp_extract_all(' ' || replace(full_value, ' ', '  ') || ' ', '[^A-Za-z0-9_]' || replace(raw_value, '.', '[.]') || '[^A-Za-z0-9_]')) = 1 then 'safe' else 'ambiguous' end as safety from {v('occ_length')}",
    "build_plan": f"""with all_ as ({v("occ_color")}), occ as (select * from all_ where line % 3 = 0), {COLOR_NAMES.removeprefix("occ as (" + v("occ_color") + "),")},
        spelled2 as (select value, max(name) as name from (select value, name from tokens union all select lower(value), name from tokens) group by value),
        found as (select raw_value, coalesce(a.name, b.name, n2.name) as token_name, file from all_ left join spelled2 a on a.value = raw_value left join spelled2 b on b.value = lower(raw_value)
            left join all_names n2 on n2.value = lower(raw_value))
        select raw_value, token_name, case when file like '%.scss' then '$' || token_name else 'var(--' || token_name || ')' end as replacement, true as safe, count(*) as n from found group by all""",
    "plan_counts": f"""with safety as (select *, len(regexp_extract_all(' ' || replace(full_value, ' ', '  ') || ' ', '[^A-Za-z0-9_]' || replace(raw_value, '.', '[.]') || '[^A-Za-z0-9_]')) = 1 as safe from {v("occ_length")})
        select file, count(*) filter (where safe) as replaced, count(*) filter (where not safe) as skipped from safety group by file""",
    "edit_running_shift": f"""with edits as (select file, ord * 40 as start, ord * 40 + length(raw_value) as "end", 'var(--space)' as replacement from {v("occ_length")}),
        moved as (select *, coalesce(sum(12 - ("end" - start)) over (partition by file order by start rows between unbounded preceding and 1 preceding), 0) as shift from edits)
        select file, start, "end", replacement, (start + shift)::bigint as new_start, (start + shift + 12)::bigint as new_end from moved""",
    "lock_diff": f"""with {COLOR_NAMES}, fresh as (select cluster_id as id, name from tokens),
        locked as (select cluster_id as id, case when substr(value, 2, 1) = '4' then 'locked-' || name else name end as name, false as merged from tokens where substr(value, 2, 1) not in ('2', '3')
            union all select {fnv("'color::' || value || '-old'")}, name, substr(value, 2, 1) = '0' from tokens where substr(value, 2, 1) in ('0', '1'))
        select coalesce(f.id, l.id) as id, case when l.id is null then 'added' when f.id is null and merged then 'kept' when f.id is null then 'removed' when f.name <> l.name then 'renamed' else 'unchanged' end as change,
            l.name as locked_name, f.name as fresh_name from fresh f full join locked l using (id)""",
    "merge_tokens": f"""with {COLOR_NAMES}, mapped as (select *, case when substr(value, 2, 1) = '1' then {fnv("'color::#0' || substr(value, 3, 5)")} end as target from tokens),
        extra as (select target, sum(occurrence_count) as more, max(file_count) as most from mapped where target is not null group by 1)
        select m.cluster_id, value, (occurrence_count + coalesce(more, 0))::bigint as occurrence_count, greatest(file_count, coalesce(most, 0)) as file_count from mapped m left join extra e on e.target = m.cluster_id where m.target is null""",
    "review_groups": f"""with recursive {NEAR_COLORS}, ids as (select cluster_key, {fnv("'color::' || canonical_value")} as id from groups),
        edges as (select a.id as x, b.id as y from near join ids a on a.cluster_key = p join ids b on b.cluster_key = q),
        reach(x, y) as (select x, x from edges union select r.x, e.y from reach r join edges e on e.x = r.y)
        select x as cluster_id, min(y) as group_id from reach group by x""",
    "expand_composites": f"""with {SHADOW}, place as (select file, line, "column", property, min(struct_pack(o := ord, v := full_value)) as x from occ where property = 'box-shadow' group by all),
        layer as (select unnest(string_split(x.v, ', ')) as t from place),
        made as (select 'shadow' as category, trim(regexp_replace(t, ' #.*', '')) as raw_value, 'shadow-shape' as role from layer union all select 'color', regexp_extract(t, '#.*'), 'shadow-color' from layer
            union all select category, raw_value, 'kept' from occ where property <> 'box-shadow')
        select category, raw_value, role, count(*) as n from made group by all""",
    "shadow_parts": f"""with {SHADOW}, p as (select distinct full_value, string_split(full_value, ' ') as w, full_value like '%,%' as two from occ where property = 'box-shadow')
        select full_value, case when not two then w[1] end as "offsetX", case when not two then w[2] end as "offsetY", case when not two then w[3] end as blur, case when not two then w[4] end as color, case when two then '2' end as layers from p""",
    "extract_typography": f"""with rows as (select * from {v("occ_font")}),
        last as (select file, selector, block, property, last(raw_value order by ord) as raw_value, min(struct_pack(o := ord, l := line)) as first from rows group by all)
        select file, selector, block, min(first).l as line, string_agg(case property when 'font-size' then 'fontSize' when 'font-weight' then 'fontWeight' else 'lineHeight' end || ': ' || raw_value, '; '
            order by case property when 'font-size' then 1 when 'font-weight' then 2 else 3 end) as typography from last group by file, selector, block having count(*) >= 2""",
    "css_roundtrip": """with rules as (select l_orderkey, l_linenumber, '.s' || (l_partkey % 40)::varchar as selector, ((l_partkey % 24) * 4)::varchar || 'px' as raw_value from lineitem)
        select l_orderkey, row_number() over (partition by l_orderkey order by l_linenumber, selector || ' { padding: ' || raw_value || '; }')::int as line, (length(selector) + 4)::int as "column", selector, 'padding' as property, raw_value, 'spacing' as category from rules""",
    "rename_references": f"""with sheets as (select replace(contents, 'padding: 4px', 'padding: var(--space-4) $space-4') as c from {SHEETS}),
        n as (select 2 * ((length(c) - length(replace(c, '$space-4', ''))) // 8) as references_n, length(replace(replace(c, 'var(--space-4)', 'var(--gap-s)'), '$space-4', '$gap-s')) as chars from sheets)
        select references_n::int as "references", count(*) as files, sum(chars)::bigint as chars from n group by 1""",
    "sort_tokens": f"with {COLOR_NAMES} select name, row_number() over (partition by category order by occurrence_count desc, name) as by_count, row_number() over (partition by category order by name) as by_name from tokens",
    "sink_css": f"with {COLOR_NAMES} select category, name, '  --' || name || ': ' || value || '; /* used ' || occurrence_count || 'x across ' || file_count || ' file(s) */' as line from tokens",
    "sink_dtcg": f"""with {COLOR_NAMES}, c as (select *, [{", ".join(f"floor({byte('value', at)} / 255e0 * 1000e0 + 0.5e0) / 1000e0" for at in (2, 4, 6))}] as t from tokens)
        select category, name, '{{"colorSpace":"srgb","components":[' || t[1]::varchar || ',' || t[2]::varchar || ',' || t[3]::varchar || '],"alpha":1.0}}' as json from c""",
    "union_sources": f"select file, category, count(*) as n from (select file, category from {v('occ_color')} union all select file, category from {v('occ_fontsize')}) group by all",
    "dedupe_findings": f"select file, selector, property, raw_value, min(ord) as ord, first(line order by ord) as line from {v('occ_contrast')} group by file, selector, property, raw_value",
    "nearest_reference": f"""with recursive palette(i, name, hex) as (values {PALETTE}), swatch as (select i, name, {", ".join(f"{x} as {k}" for k, x in zip("lab", lab("hex"), strict=True))} from palette),
        c as (select value, {", ".join(f"{x} as {k}" for k, x in zip("lab", lab("value"), strict=True))} from (select distinct lower(raw_value) as value from {v("occ_color")})),
        dist as (select value, i, name, sqrt(pow(c.l - s.l, 2) + pow(c.a - s.a, 2) + pow(c.b - s.b, 2)) as d from c, swatch s),
        fold(value, i, name, best, raw) as (select distinct value, -1, null::varchar, 1e308::double, 1e308::double from c
            union all select f.value, d.i, case when d.d < best then d.name else f.name end, case when d.d < best then floor(d.d * 100 + 0.5e0) / 100 else best end, case when d.d < best then d.d else raw end from fold f join dist d on d.value = f.value and d.i = f.i + 1)
        select value, name as reference, best as delta_e, raw <= 3 as used_for_name from fold where i = (select max(i) from palette) and best <= 6""",
}
ORACLE_SQL["build_plan"] = ORACLE_SQL["build_plan"].replace("all_names n2", f"(with {HSL} select value, name from named) n2")


# Colours in every notation, worked out from the fields that they are made of.


def dbl(x: str) -> str:
    return f"(({x})::double)"


def hue_part(n: int, h: str, s: str, light: str) -> str:
    """A channel of a hue, saturation and lightness: n is 0 for red, 8 for green, 4 for blue."""
    k = f"(({n} + {h} / 30e0) % 12)"
    return f"({light} - {s} * least({light}, 1 - {light}) * greatest(-1, least({k} - 3, 9 - {k}, 1)))"


Q = "(cast(l_quantity as bigint))"
HUE = dbl("l_partkey % 36 * 10")
WHITE, BLACK = dbl("l_suppkey % 5 / 10e0"), dbl(f"{Q} % 5 / 10e0")


def css_channel(i: int) -> str:
    own = (RED, GREEN, BLUE)[i]
    nibble = ("l_partkey % 16", "l_suppkey % 16", f"{Q} % 16")[i]
    n = (0, 8, 4)[i]
    hsl = hue_part(n, HUE, dbl("l_suppkey % 5 / 4e0"), dbl(f"{Q} % 5 / 4e0"))
    hwb = f"({hue_part(n, HUE, '1e0', '0.5e0')} * (1 - {WHITE} - {BLACK}) + {WHITE})"
    return f"case l_linenumber when 1 then {dbl(nibble)} * 17 when 5 then {hsl} * 255 when 6 then {hwb} * 255 else {dbl(own)} end"


CSS_ALPHA = "case l_linenumber when 3 then (l_partkey % 9 + 1) / 10e0 when 4 then (l_partkey % 9) / 10e0 when 7 then (l_partkey % 5 * 51) / 255e0 else 1e0 end"
CSS_PARTS = f"parts as (select l_linenumber, {css_color(True)} as raw_value, {css_channel(0)} as r, {css_channel(1)} as g, {css_channel(2)} as b, {CSS_ALPHA} as a from lineitem)"


def two(x: str) -> str:
    return f"printf('%02x', floor({x} + 0.5e0)::bigint)"


def gamma(x: str) -> str:
    return f"greatest(0e0, least(255e0, 255e0 * (case when {x} <= 0.0031308e0 then {x} * 12.92e0 else sign({x}) * pow(abs({x}), 1 / 2.4e0) * 1.055e0 - 0.055e0 end)))"


def dot(names: tuple[str, str, str], weights: tuple[float, float, float]) -> str:
    return "(" + " + ".join(f"{n} * {w}e0" for n, w in zip(names, weights, strict=True)) + ")"


def unlab(t: str) -> str:
    return f"(case when pow({t}, 3) > 0.008856e0 then pow({t}, 3) else ({t} - 16e0 / 116e0) / 7.787e0 end)"


TENTH = "(l_partkey % 11 * 10)"
LAB_PARTS = f"""raw as (select {view("occ_lab", True).split(" as raw_value")[0].rsplit("property, ", 1)[1].split("'color' as ")[-1]} as raw_value, l_linenumber % 5 as mode, {dbl(TENTH)} as l0, {dbl("l_suppkey % 9")} as s, {dbl(f"{Q} % 9")} as q, radians({dbl("l_partkey % 24 * 15")}) as h,
        {dbl("l_partkey % 10")} / 10 as p0, {dbl("l_suppkey % 10")} / 10 as p1, {dbl(f"{Q} % 5 * 20")} / 100 as p2 from lineitem),
    lab0 as (select *, case mode when 0 then s * 5 - 20 when 1 then s * 5 * cos(h) when 2 then s / 100 when 3 then s / 100 * cos(h) end as a0,
        case mode when 0 then q * 5 - 20 when 1 then s * 5 * sin(h) when 2 then -q / 100 when 3 then s / 100 * sin(h) end as b0 from (select distinct * from raw)),
    d50 as (select *, {unlab("((l0 + 16) / 116 + a0 / 500)")} * 0.96422e0 as x5, {unlab("((l0 + 16) / 116)")} as y5, {unlab("((l0 + 16) / 116 - b0 / 200)")} * 0.82521e0 as z5,
        pow(l0 / 100 + 0.3963377774e0 * a0 + 0.2158037573e0 * b0, 3) as ol, pow(l0 / 100 - 0.1055613458e0 * a0 - 0.0638541728e0 * b0, 3) as om, pow(l0 / 100 - 0.0894841775e0 * a0 - 1.2914855480e0 * b0, 3) as os,
        {linear("(p0 * 255e0)")} as q0, {linear("(p1 * 255e0)")} as q1, {linear("(p2 * 255e0)")} as q2 from lab0),
    xyz as (select *, case when mode = 4 then {dot(("q0", "q1", "q2"), (0.4865709, 0.2656677, 0.1982173))} else {dot(("x5", "y5", "z5"), (0.9555766, -0.0230393, 0.0631636))} end as x,
        case when mode = 4 then {dot(("q0", "q1", "q2"), (0.2289746, 0.6917385, 0.0792869))} else {dot(("x5", "y5", "z5"), (-0.0282895, 1.0099416, 0.0210077))} end as y,
        case when mode = 4 then {dot(("q0", "q1", "q2"), (0.0, 0.0451134, 1.0439444))} else {dot(("x5", "y5", "z5"), (0.0122982, -0.0204830, 1.3299098))} end as z from d50),
    lin as (select raw_value, case when mode in (2, 3) then {dot(("ol", "om", "os"), (4.0767416621, -3.3077115913, 0.2309699292))} else {dot(("x", "y", "z"), (3.2404542, -1.5371385, -0.4985314))} end as r,
        case when mode in (2, 3) then {dot(("ol", "om", "os"), (-1.2684380046, 2.6097574011, -0.3413193965))} else {dot(("x", "y", "z"), (-0.9692660, 1.8760108, 0.0415560))} end as g,
        case when mode in (2, 3) then {dot(("ol", "om", "os"), (-0.0041960863, -0.7034186147, 1.7076147010))} else {dot(("x", "y", "z"), (0.0556434, -0.2040259, 1.0572252))} end as b from xyz)"""
BACK = {"r": 51, "g": 102, "b": 153}


def flat(c: str) -> str:
    """A channel of a colour over the fixed one."""
    return f"({c} * a + {BACK[c]}e0 * (1 - a))"


def lum(channels: tuple[str, str, str]) -> str:
    return f"(0.2126e0 * {linear(channels[0])} + 0.7152e0 * {linear(channels[1])} + 0.0722e0 * {linear(channels[2])})"


OVER = lum((flat("r"), flat("g"), flat("b")))
UNDER = lum(("51e0", "102e0", "153e0"))
HEX6 = f"{two(dbl(RED))} || {two(dbl(GREEN))} || {two(dbl(BLUE))}"
N6 = "(l_partkey % 6)::varchar"
N7 = "(l_partkey % 6 + 1)::varchar"
#: By the line's number: the words of a composite with their kinds.
WORDS = f"""case l_linenumber when 1 then [['0px', 'length'], [{N6} || 'PX', 'length'], ['4px', 'length'], ['#' || upper({HEX6}), 'color']]
    when 2 then [['0', 'length'], [{N6} || 'px', 'length'], ['4px', 'length'], ['rgb(' || ({RED})::varchar || ', ' || ({GREEN})::varchar || ', ' || ({BLUE})::varchar || ')', 'color']]
    when 3 then [['inset', 'keyword'], ['0', 'length'], ['1px', 'length'], ['2px', 'length'], ['rgba(' || ({RED})::varchar || ', ' || ({GREEN})::varchar || ', ' || ({BLUE})::varchar || ', 0.5)', 'color']]
    when 4 then [[{N7} || 'px', 'length'], ['SOLID', 'keyword'], ['#' || {HEX6}, 'color']]
    when 5 then [['all', 'keyword'], [{N7} || '00ms', 'length'], ['Ease-In-Out', 'keyword']]
    when 6 then [['opacity', 'keyword'], ['.' || {N7} || 's', 'length'], ['cubic-bezier(0.4, 0, 0.2, 1)', 'function'], ['50ms', 'length']]
    else [['color', 'keyword'], ['1s', 'length'], ['width', 'keyword'], [{N6} || 's', 'length']] end"""
NORMAL = f"""case l_linenumber when 1 then '0 ' || case when l_partkey % 6 = 0 then '0' else {N6} || 'px' end || ' 4px #' || {HEX6} when 2 then '0 ' || case when l_partkey % 6 = 0 then '0' else {N6} || 'px' end || ' 4px #' || {HEX6}
    when 3 then 'inset 0 1px 2px #' || {HEX6} || '@0.5' when 4 then {N7} || 'px solid #' || {HEX6} when 5 then 'all ' || {N7} || '00ms ease-in-out'
    when 6 then 'opacity .' || {N7} || 's cubic-bezier(0.4, 0, 0.2, 1) 50ms' else 'color 1s width ' || case when l_partkey % 6 = 0 then '0' else {N6} || 's' end end"""
COMPOSITE = view("occ_composite", True)
RAW = COMPOSITE.split("as property, ", 1)[1].split(" as raw_value", 1)[0]
LITERAL_JSON = [
    ("dimension", '{"value":4,"unit":"px"}'), ("dimension", '{"value":1.5,"unit":"rem"}'), ("fontWeight", "400"), ("number", "0.5"), ("duration", '{"value":200,"unit":"ms"}'), ("cubicBezier", "[0.42,0,1,1]"),
    ("cubicBezier", "[0.4,0,0.2,1]"), ("number", "1.5"), ("fontFamily", '["Open Sans","Arial","serif"]'),
    ("shadow", '{"color":{"colorSpace":"srgb","components":[1.0,0.0,0.0],"alpha":1.0},"offsetX":{"value":0,"unit":"px"},"offsetY":{"value":1,"unit":"px"},"blur":{"value":2,"unit":"px"},"spread":{"value":0,"unit":"px"}}'),
    ("border", '{"color":{"colorSpace":"srgb","components":[0.0,1.0,0.0],"alpha":1.0},"width":{"value":2,"unit":"px"},"style":"solid"}'),
    ("transition", '{"duration":{"value":0.3,"unit":"s"},"delay":{"value":50,"unit":"ms"},"timingFunction":[0.25,0.1,0.25,1]}'),
    ("typography", '{"fontFamily":["Arial"],"fontSize":{"value":16,"unit":"px"},"fontWeight":700,"lineHeight":1.5}'), ("typography", '{"fontSize":{"value":16,"unit":"px"},"lineHeight":1.5}'), ("shadow", '"0 1px 2px #ff0000, inset 0 0 1px #00ff00"'), ("number", "10"),
]
LITERAL_STUDIO = {
    0: '"4px"', 9: "blur=2px;color=#ff0000;spread=0;type=dropShadow;x=0;y=1px", 10: "color=rgb(0, 255, 0);style=solid;width=2px", 12: "fontFamily=Arial;fontSize=16px;fontWeight=700;lineHeight=1.5", 13: "fontSize=16px;lineHeight=1.5",
    14: '"0 1px 2px #ff0000, inset 0 0 1px #00ff00"',
}
LITERAL_NAMES = ["space-4", "radius-24", "font-weight-400", "opacity-50", "duration-200ms", "easing-ease-in", "easing-cubic-bezier-0-4-0-2-1", "line-height-1-5", "font-family-open-sans", "shadow-1px-2px", "border-2px-solid-rgb-0-255-0", "transition-all-3s-ease-50ms", "typography-16px", "typography-16px", "shadow-2-layer", "z-index-10"]


def text(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def rows_of(values: list[tuple]) -> str:
    return ", ".join("(" + ", ".join(str(v) if isinstance(v, int) else text(v) for v in row) + ")" for row in values)


SHOWN = {i: v for i, (c, v) in enumerate(LITERALS) if c != "typography"} | {12: "700 16px/1.5 Arial"}
#: The tokens of COLOR_NAMES under a lock without those that begin with 2 or 3, with others that are gone or merged.
LOCKED = f"""locked as (select cluster_id as id, 'locked-' || name as name, value, null::varchar as merged_with from tokens where substr(value, 2, 1) not in ('2', '3')
        union all select {fnv("'color::' || value || '-old'")}, name, value || '-old', case when substr(value, 2, 1) = '0' then 'x' end from tokens where substr(value, 2, 1) in ('0', '1'))"""

ORACLE_SQL |= {
    "color_functions": f"with {CSS_PARTS} select distinct raw_value, round(r, 6) as r, round(g, 6) as g, round(b, 6) as b, round(a, 6) as a from parts",
    "color_lab_functions": f"with {LAB_PARTS} select distinct raw_value, " + ", ".join(f"round({gamma(c)}, 4) as {c}" for c in "rgb") + " from lin",
    "color_key_spellings": f"with {CSS_PARTS} select '#' || {two('r')} || {two('g')} || {two('b')} || case when a < 1 then '@' || case when a = 0 then '0' else a::varchar end else '' end as cluster_key, count(*) as n from parts where l_linenumber not in (5, 6) group by 1",
    "composite_over": f"with {CSS_PARTS}, one as (select distinct * exclude (l_linenumber) from parts) select raw_value, " + ", ".join(f"round({flat(c)}, 6) as {c}" for c in "rgb") + f", 1e0 as a, round((greatest({OVER}, {UNDER}) + 0.05e0) / (least({OVER}, {UNDER}) + 0.05e0), 6) as ratio from one",
    "to_hsl": f"with {HSL} select value, round(h, 6) as h, round(s, 6) as s, round(l, 6) as l from hsl",
    "to_hex": f"select distinct raw_value, lower(raw_value) as hex from {v('occ_color')}",
    "tokenize_composite": f"with w as (select distinct {RAW} as raw_value, {WORDS} as w from lineitem) select raw_value, (i - 1)::bigint as place, w[i][1] as raw, w[i][2] as kind from w, unnest(range(1, len(w) + 1)) as t(i)",
    "normalize_composite": f"select case when l_linenumber < 4 then 'shadow' when l_linenumber = 4 then 'border' else 'transition' end as category, {NORMAL} as cluster_key, count(*) as n, count(distinct {RAW}) as members_n from lineitem group by 1, 2",
    "parse_border": f"select distinct {RAW} as raw_value, {N7} || 'px' as width, 'solid' as style, '#' || {HEX6} as color from lineitem where l_linenumber = 4",
    "parse_transition": f"""select distinct {RAW} as raw_value, case l_linenumber when 5 then {N7} || '00ms' when 6 then '.' || {N7} || 's' end as duration, case l_linenumber when 5 then '0s' when 6 then '50ms' end as delay,
        case l_linenumber when 5 then 'ease' when 6 then 'cubic-bezier(0.4, 0, 0.2, 1)' end as "timingFunction", case when l_linenumber = 7 then '2' end as layers from lineitem where l_linenumber > 4""",
    "rx_time_easing": f"""select distinct {RAW} as raw_value, case l_linenumber when 5 then {N7} || '00ms' when 6 then '.' || {N7} || 's|50ms' else '1s|' || {N6} || 's' end as times,
        case l_linenumber when 5 then 'ease-in-out' when 6 then 'cubic-bezier(0.4, 0, 0.2, 1)' else '' end as easings from lineitem where l_linenumber > 4""",
    "slug": """with t as (select distinct ' "' || p_name || '" (' || p_brand || ') -- ' || p_type || '! ' as text from part)
        select text, trim(regexp_replace(lower(replace(text, '"', '')), '[^a-z0-9]+', '-', 'g'), '-') as slug, regexp_replace(replace(trim(text), '"', ''), ' +', ' ', 'g') as normalized from t""",
    "sink_dtcg_values": f"select 't' || p_partkey as name, t as dtcg_type, j as json from part join (values {rows_of([(i, *x) for i, x in enumerate(LITERAL_JSON)])}) as x(i, t, j) on p_partkey % {len(LITERALS)} = i",
    "sink_studio_values": f"select 't' || p_partkey as name, j as studio from part join (values {rows_of(list(LITERAL_STUDIO.items()))}) as x(i, j) on p_partkey % {len(LITERALS)} = i",
    "sink_stylesheet_values": f"""with x(i, v) as (values {rows_of(list(SHOWN.items()))}), rows as (select 't' || p_partkey as name, v, 'used ' || p_partkey % 9 || 'x across ' || p_partkey % 4 || ' file(s)' as u from part join x on p_partkey % {len(LITERALS)} = i)
        select name, '  --' || name || ': ' || v || '; /* ' || u || ' */' as line from rows union all select name, '$' || name || ': ' || v || '; // ' || u from rows""",
    "rule_names": f"select * from (values {rows_of([(c, x, n) for (c, x), n in zip(LITERALS, LITERAL_NAMES, strict=True)])}) as x(category, value, name)",
    "merged_lock": f"""with {COLOR_NAMES}, {LOCKED}
        select id, name, value, 'before' as created_at, merged_with from locked where merged_with is not null or id in (select cluster_id from tokens)
        union all select cluster_id, name, value, 'now', null from tokens where cluster_id not in (select id from locked)""",
    "merge_clusters": f"""with {COLOR_CLUSTERS}, c as (select cluster_key, n, len(members) as m, {fnv("'color::' || canonical_value")} as id, case when substr(canonical_value, 2, 1) = '1' then {fnv("'color::#0' || substr(canonical_value, 3, 5)")} end as target from groups),
        home as (select *, case when target in (select id from c) then target else id end as h from c)
        select h as cluster_id, sum(n)::bigint as n, sum(m)::bigint as members_n from home group by 1""",
    "lock_lookup": f"""with {COLOR_NAMES}, held as (select cluster_key, name from tokens where substr(value, 3, 1) < '8')
        select distinct upper(raw_value) as raw_value, name as locked_name, name is not null as locked from {v("occ_color")} o left join held on cluster_key = lower(raw_value)""",
    "alias_lookup": f"""with {COLOR_NAMES}, wish as (select name, case when value like '#2%' then null when value like '#0%' then 'brand' else 'my-' || name end as w from tokens)
        select name, case when w is not null and row_number() over (partition by w order by name) = 1 then w end as alias from wish""",
    "review_cards": f"""with recursive {NEAR_COLORS}, pending as (select g.cluster_key, canonical_value, {fnv("'color::' || canonical_value")} as id from groups g where n >= 30 and cluster_key in (select p from near)),
        edges as (select a.id as x, b.id as y from near join pending a on a.cluster_key = p join pending b on b.cluster_key = q),
        reach(x, y) as (select id, id from pending union select r.x, e.y from reach r join edges e on e.x = r.y),
        home as (select x, min(y) as g from reach group by x), cards as (select 'cluster-group' as kind, sum(length(canonical_value)) + 2 * (count(*) - 1) as chars from home join pending on id = x group by g
            union all select 'below-threshold', length(canonical_value) from groups where n < 30)
        select kind, count(*) as n, sum(chars)::bigint as chars from cards group by kind""",
    "plan_items": f"""select file || ':' || line || ':' || "column" || ':' || property || ':' || ord as item_id, line, true as accepted, false as assisted from {v("occ_color")}""",
}
