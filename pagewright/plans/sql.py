"""Shared pieces of the SQL twins. They restate the rules with other means than the operators."""

HIDDEN = (r"(?is)<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>"
          r"|<noscript\b[^>]*>.*?</noscript\s*>|<template\b[^>]*>.*?</template\s*>")
ENDERS = (r"(?i)</(?:p|div|li|tr|h1|h2|h3|br)\s*>|<(?:p|div|li|tr|h1|h2|h3|br)(?:\s[^>]*)?/>")


def entities(x: str) -> str:
    for name, char in (("copy", "©"), ("middot", "·"), ("quot", '"'), ("lt", "<"), ("gt", ">")):
        x = f"replace({x},'&{name};','{char}')"
    # Cut-off titles end in an ampersand entity without its semicolon, which decodes all the same.
    return f"regexp_replace({x},'&amp;?','&','g')"


def collapse(x: str) -> str:
    return rf"trim(regexp_replace({x},'\s+',' ','g'))"


# page_id, url, html, lines, txt
TEXT = rf"""
_flat AS (SELECT page_id, url, html, regexp_replace(regexp_replace(regexp_replace(
    html,'{HIDDEN}','<x>','g'),'(?s)<!--.*?-->|<![^>]*>','<x>','g'),
    '{ENDERS}','<x>'||chr(1)||'<x>','g') AS f FROM pages),
_chunks AS (SELECT page_id, url, html, array_to_string(list_transform(string_split_regex(f,'<[^>]*>'),
    lambda c: {collapse(entities(entities("c")))}),'') AS f FROM _flat),
_lines AS (SELECT page_id, url, html, list_filter(list_transform(string_split(f,chr(1)),
    lambda l: {collapse("l")}), lambda l: l<>'') AS lines FROM _chunks),
view AS (SELECT page_id, url, html, lines, array_to_string(lines,chr(10)) AS txt FROM _lines)"""

# page_id, n, tag, text: the blocks of a page in order
BLOCKS = rf"""
_bare AS (SELECT page_id, regexp_replace(regexp_replace(html,'{HIDDEN}','','g'),'(?s)<!--.*?-->','','g') AS h
    FROM pages),
_cut AS (SELECT page_id, h, string_split(regexp_replace(h,'<(p|li|h1)>',chr(1)||'<\1>','g'),chr(1)) AS s FROM _bare),
_seg AS (SELECT page_id, n, s[n+1] AS seg FROM _cut, unnest(range(1,len(s))) AS t(n)),
_blk AS (SELECT page_id, n, regexp_extract(seg,'^<(p|li|h1)>',1) AS tag,
    {collapse(entities(r"regexp_replace(regexp_extract(seg,'(?s)^<(?:p|li|h1)>(.*?)(?:</(?:p|li|h1|article|ul|nav)>|$)',1),'<[^>]*>',' ','g')"))} AS text
    FROM _seg),
blk AS (SELECT page_id, n, tag, text, row_number() OVER (PARTITION BY page_id, tag ORDER BY n) AS nth,
    count(*) OVER (PARTITION BY page_id, tag) AS same FROM _blk)"""

# page_id, article: cleaned text of the article
ARTICLE = rf"""
_art AS (SELECT page_id, {collapse(entities(
    r"regexp_replace(regexp_extract(html,'(?s)<article>(.*?)</article>',1),'<[^>]*>',' ','g')"))} AS article FROM pages)"""

# page_id, markup: the article with its texts cleaned; needs blk. Bold text is never closed and ends with its paragraph.
MARKUP = r"""
_esc AS (SELECT b.page_id, b.n, b.tag, b.text='' AS bare, contains(seg,'<b>') AS bold,
    replace(replace(replace(b.text,'&','&amp;'),'<','&lt;'),'>','&gt;') AS x FROM blk b JOIN _seg USING (page_id, n) WHERE b.tag<>'li'),
mk AS (SELECT page_id, '<article>'||string_agg('<'||tag||'>'||CASE WHEN bold THEN '<b>'||x||CASE WHEN bare THEN '' ELSE ' ' END||'<br></b>'
    ELSE x END||'</'||tag||'>','' ORDER BY n)||'</article>' AS markup FROM _esc GROUP BY 1)"""

AD = rf"""SELECT page_id, left({collapse(entities("regexp_extract(html,'(?s)<div class=.ad.>(.*?)</div>',1)"))},240) AS ad FROM pages"""

# structural counts per page
SHAPE = BLOCKS + r""",
shape AS (SELECT page_id,
    count(*) FILTER (tag='h1' AND text<>'') AS headings,
    count(*) FILTER (tag='li' AND length(text)>=3) AS repeated,
    count(*) FILTER (tag='p' AND text<>'') AS paragraphs,
    count(*) FILTER (tag IN ('p','h1') AND text<>'') AS content_blocks,
    count(*) FILTER (text<>'') AS all_blocks
    FROM blk GROUP BY page_id),
intent AS (SELECT *, least(1.0, repeated/greatest(1,content_blocks)) AS ratio FROM shape),
judged AS (SELECT *, CASE WHEN ratio>=0.35 THEN 'list' WHEN repeated>=3 AND paragraphs=0 THEN 'home'
    WHEN headings=1 THEN 'article' ELSE 'unknown' END AS intent FROM intent)"""


def iso_date(x: str) -> str:
    """normalize_date as SQL over an already collapsed text."""
    long = r"(\d{4})\s*[年\-/.]\s*(\d{1,2})\s*[月\-/.]\s*(\d{1,2})"
    short = r"(\d{4})(\d{2})(\d{2})"

    def build(p):
        y, m, d = (f"CAST(regexp_extract({x},'{p}',{i}) AS INT)" for i in (1, 2, 3))
        return f"CASE WHEN {m} BETWEEN 1 AND 12 AND {d} BETWEEN 1 AND 31 THEN printf('%04d-%02d-%02d',{y},{m},{d}) ELSE {x} END"

    return (f"CASE WHEN regexp_matches({x},'{long}') THEN {build(long)} "
            f"WHEN regexp_matches({x},'{short}') THEN {build(short)} ELSE {x} END")


def snippet(txt: str, start: str, end: str) -> str:
    return collapse(f"substring({txt},greatest(0,{start}-60)+1,least(length({txt}),{end}+60)-greatest(0,{start}-60))")


# Needs fr(id, pos, field, ftype, required, val, ev, conf, strategy, err); gives iss(id, field, code, severity, ord)
ISSUES = rf"""
chk AS (SELECT *, val IS NULL OR trim(val)='' AS miss FROM fr),
iss AS MATERIALIZED (
  SELECT id, field, pos, 1 AS ord, 'llm_fallback_failed' AS code, CASE WHEN required THEN 'error' ELSE 'warning' END AS severity
    FROM chk WHERE status='fallback_failed'
  UNION ALL SELECT id, field, pos, 1, 'program_execution_failed', CASE WHEN required AND miss THEN 'error' ELSE 'warning' END
    FROM chk WHERE status<>'fallback_failed' AND err IS NOT NULL
  UNION ALL SELECT id, field, pos, 2, 'required_field_missing', 'error' FROM chk WHERE required AND miss
  UNION ALL SELECT id, field, pos, 3, 'field_type_mismatch', CASE WHEN required THEN 'error' ELSE 'warning' END FROM chk
    WHERE NOT miss AND NOT (CASE ftype WHEN 'date' THEN regexp_full_match(val,'\d{{4}}-\d{{2}}-\d{{2}}')
      WHEN 'number' THEN try_cast(val AS DOUBLE) IS NOT NULL WHEN 'url' THEN starts_with(val,'http') ELSE true END)
  UNION ALL SELECT id, field, pos, 4, 'date_normalization_failure', 'warning' FROM chk
    WHERE NOT miss AND ftype='date' AND {iso_date("val")}<>val
  UNION ALL SELECT id, field, pos, 5, 'evidence_not_supporting_value', 'warning' FROM chk
    WHERE NOT miss AND NOT coalesce(contains(ev,val) OR contains(replace(ev,'-',''),replace(val,'-','')) OR {iso_date("ev")}=val,false)
  UNION ALL SELECT id, field, pos, 6, 'empty_or_low_quality_evidence', CASE WHEN miss THEN 'error' ELSE 'warning' END FROM chk
    WHERE (required OR NOT miss) AND (ev IS NULL OR length(trim(ev))<4)
  UNION ALL SELECT id, field, pos, 7, 'low_confidence', 'warning' FROM chk WHERE NOT miss AND conf<
    CASE WHEN strategy IN ('css','xpath','regex_on_text','text_near_label') THEN 0.55 WHEN strategy='llm_fallback' THEN 0.35 ELSE 0 END
  UNION ALL SELECT p.id, 'publish_date', 99, 9, 'publish_date_deadline_confusion', 'warning' FROM fr p JOIN fr d ON p.id=d.id
    AND p.field='publish_date' AND d.field='deadline' WHERE coalesce(p.val,'')<>'' AND p.val=d.val
    AND (contains(coalesce(p.ev,''),'截止') OR contains(coalesce(d.ev,''),'发布'))),
rep AS (SELECT b.id, coalesce(e,0) AS error_count, coalesce(w,0) AS warning_count FROM (SELECT DISTINCT id FROM fr) b
  LEFT JOIN (SELECT id, count(*) FILTER (severity='error') AS e, count(*) FILTER (severity='warning') AS w FROM iss GROUP BY 1) USING (id))"""

REPORT = """SELECT id AS page_id, error_count=0 AS passed, error_count, warning_count,
  round(greatest(0,1-0.25*error_count-0.08*warning_count),4) AS score FROM rep"""
