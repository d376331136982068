"""Plain SQL twins of the registered queries, written for DuckDB.

They take other roads than the Spark side where that is possible: windows and joins over token
rows in place of folds over arrays.
"""

from __future__ import annotations

from lexmill.functions import fixed
from lexmill.plans.code_tables import cte
from lexmill.plans.queries import SEQUENCE_LIMIT, SPLIT_SEED

WS = r"[\t-\r\x1c-\x20\x{85}\p{Z}]"
NOT_WS = r"[^\t-\r\x1c-\x20\x{85}\p{Z}]"
NL = "chr(10)"


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def with_(*parts: str, select: str) -> str:
    return "with recursive " + ",\n".join(parts) + "\n" + select


def replace(expr: str, old: str, new: str) -> str:
    def operand(text: str) -> str:
        return NL if text == "\n" else "chr(9)" if text == "\t" else "chr(13)" if text == "\r" else lit(text)

    return f"replace({expr}, {operand(old)}, {operand(new)})"


def replace_all(expr: str, pairs) -> str:
    for old, new in pairs:
        expr = replace(expr, old, new)
    return expr


def regex(expr: str, pattern: str, new: str) -> str:
    return f"regexp_replace({expr}, {lit(pattern)}, {lit(new)}, 'g')"


def strip(expr: str) -> str:
    return regex(expr, rf"^{WS}+|{WS}+$", "")


# --- cleaning ------------------------------------------------------------------------------

SEGMENT = (
    r"(?s)//[^\n]*|/\*.*?\*/|'[^'\\]*(?:\\.[^'\\]*)*'"
    r'|"[^"\\]*(?:\\.[^"\\]*)*"'
    r"""|[^/'"]+|."""
)


def n1(code: str) -> str:
    return (
        f"array_to_string(list_transform(regexp_extract_all({code}, {lit(SEGMENT)}), "
        "lambda x: case when x[1:2] in ('//', '/*') then ' ' else x end), '')"
    )


def n2(code: str) -> str:
    return regex(code, rf"(?m){WS}+$", "")


def n3(code: str) -> str:
    return regex(code, r"(?m)^$\n", "")


# --- lexing --------------------------------------------------------------------------------

COMMENT = r"//[^\n\\]*(?:\\.[^\n\\]*)*|/\*.*?\*/"
CHAR = r"(?:u8|[LuU])?'[^'\\\n]*(?:\\.[^'\\\n]*)*'"
STRING = r'(?:u8|[LuU])?"[^"\\\n]*(?:\\.[^"\\\n]*)*"'
WORD = r"[\p{L}_$][\p{L}\p{N}_$]*"
NUMBER = (
    r"0[xX][0-9a-fA-F'_]+(?:\.[0-9a-fA-F]*)?(?:[pP][+-]?[0-9]+)?[uUlLfF]*|0[bB][01'_]+[uUlL]*"
    r"|(?:[0-9][0-9'_]*(?:\.[0-9_]*)?|\.[0-9][0-9_]*)(?:[eE][+-]?[0-9]+)?[uUlLfFdD]*"
)
CPP_OPERATORS = r"->\*|->|\+\+|--|<<=|>>=|<=>|\.\.\.|\.\*|<<|>>|::|[-+*/%&|^=!<>]=|&&|\|\|"
JAVA_OPERATORS = r"->|\+\+|--|>>>=|<<=|>>=|>>>|\.\.\.|<<|>>|::|[-+*/%&|^=!<>]=|&&|\|\|"
DIRECTIVE = r"(?:^[ \t]*#[ \t]*[A-Za-z](?:[^\n\\/]|\\.)*\n?)"
CPP_LEX = "(?sm)" + "|".join((DIRECTIVE, COMMENT, CHAR, STRING, WORD, NUMBER, CPP_OPERATORS, NOT_WS))
JAVA_LEX = "(?s)" + "|".join((COMMENT, CHAR, STRING, WORD, NUMBER, JAVA_OPERATORS, NOT_WS))


def _tag(keywords, char_tag: str) -> str:
    words = ", ".join(lit(k) for k in keywords)
    return f"""case
      when regexp_full_match(t, {lit(WORD)}) then
        case when t in ({words}) then t when m[i - 1] in ('.', '->') then 'field_identifier' else 'identifier' end
      when regexp_matches(t, '^\\.?[0-9]') then 'number_literal'
      when t[1:2] in ('//', '/*') then 'comment'
      when length(t) > 1 and regexp_matches(t, '^(u8|[LuU])?"') then 'string_literal'
      when length(t) > 1 and regexp_matches(t, {lit("^(u8|[LuU])?'")}) then {lit(char_tag)}
      else t end"""


def lex(source: str, code: str = "code", keys: str = "id", lang: str = "cpp", name: str = "tok") -> str:
    """CTEs that end in ``name(keys, pos, token, tag)``."""
    pattern = CPP_LEX if lang == "cpp" else JAVA_LEX
    keywords, char_tag = (
        (fixed.CPP_KEYWORDS, "char_literal") if lang == "cpp" else (fixed.JAVA_KEYWORDS, "character_literal")
    )
    plain = f"[{{token: t, tag: {_tag(keywords, char_tag)}}}]"
    if lang == "cpp":
        plain = f"""case
      when t[1:8] = '#include' then [{{token: '#include', tag: '#include'}},
        {{token: regexp_extract(t, '<[^>]*>'), tag: 'system_lib_string'}}, {{token: {NL}, tag: {NL}}}]
      when t[1:7] = '#define' then [{{token: '#define', tag: '#define'}},
        {{token: regexp_extract(t, '#define (\\w+) ', 1), tag: 'identifier'}},
        {{token: regexp_extract(t, '#define \\w+ ([^\\n]*)', 1), tag: 'preproc_arg'}}, {{token: {NL}, tag: {NL}}}]
      when t[1:6] = '#endif' then regexp_extract_all(t, '#endif|[^ \\n]+').list_transform(lambda u:
        {{token: u, tag: case when u = '#endif' then u else '?' end}})
      else {plain} end"""
    return f"""{name}_m as (select {keys}, regexp_extract_all({replace(code, chr(13), "")}, {lit(pattern)}) as m from {source}),
{name}_p as (select {keys}, flatten(list_transform(m, lambda t, i: {plain})) as p from {name}_m),
{name}_u as (select {keys}, cast(generate_subscripts(p, 1) - 1 as int) as pos, unnest(p) as s from {name}_p),
{name} as (select {keys}, pos, s.token as token, s.tag as tag from {name}_u)"""


DOCUMENTS = "docs as (select doc_id as id, text as code from documents)"
PAGES = "docs as (select page_id as id, html as code from pages)"

# --- literals ------------------------------------------------------------------------------


def t1(x: str) -> str:
    return replace_all(x, ((" ", " ▁ "), ("\n", " STRNEWLINE "), ("\t", " TABSYMBOL ")))


def t2(x: str, specials=fixed.C_SPECIALS) -> str:
    return replace_all(x, [(char, f" {name} ") for name, char in specials])


def t3(x: str) -> str:
    return regex(x, " +", " ")


def t5(x: str) -> str:
    return f"length({regex(x, r'[^\p{L}\p{N}_]+', '')}) < 2"


def t6(x: str) -> str:
    return f"""case when starts_with({strip(x)}, 'STOKEN00') then
      case when contains({x}, ' STRNEWLINE ') then regexp_replace({x}, ' STRNEWLINE ', ' ENDCOM')
      else {x} || ' ENDCOM' end else {x} end"""


PUNCT = r"[^\P{P}\\]"


def t7(x: str) -> str:
    x = regex(x, rf"([^\p{{Nd}}])({PUNCT})", r"\1 \2 ")
    x = regex(x, rf"({PUNCT})([^\p{{Nd}}])", r" \1 \2")
    return strip(regex(x, r"(\p{S})", r" \1 "))


def t8(x: str, specials=fixed.C_SPECIALS) -> str:
    return replace_all(x, specials)


def t9(x: str) -> str:
    return f"case when regexp_matches({x}, '^\\p{{L}}') then replace({x}, {x}[1] || ' ', {x}[1]) else {x} end"


def whole(source: str, keys: str, comment: str, name: str, specials=fixed.C_SPECIALS) -> str:
    """CTEs ``name(keys, x)`` with column ``x`` of ``source`` fully processed.

    ``comment`` is a condition; runs in comments must have been capped before.
    """
    return f"""{name}_1 as (select {keys}, case when {comment} then {t3("x")} else x end as x, {comment} as com from {source}),
{name}_2 as (select {keys}, com and {t5("x")} as gone, {t2(t1("x"), specials)} as x from {name}_1),
{name}_3 as (select {keys}, gone, {t6("x")} as x from {name}_2),
{name}_4 as (select {keys}, gone, {t8(replace(t3(t7(t3("x"))), chr(13), ""), specials)} as x from {name}_3),
{name} as (select {keys}, case when gone then '' else {t9("x")} end as x from {name}_4)"""


def light_comment(source: str, keys: str, name: str, specials=fixed.C_SPECIALS) -> str:
    back = [(f" {key} ", char) for key, char in specials]
    back += [(" ▁ ", " "), (" TABSYMBOL ", "\t"), ("\\r", ""), (" STRNEWLINE ", "\\n")]
    return f"""{name}_1 as (select {keys}, {t3("x")} as x from {source}),
{name}_2 as (select {keys}, {t5("x")} as gone, {t2(t1("x"), specials)} as x from {name}_1),
{name}_3 as (select {keys}, gone, {t6("x")} as x from {name}_2),
{name} as (select {keys}, case when gone then '' else {replace_all("x", back)} end as x from {name}_3)"""


def capped(source: str, column: str, name: str) -> str:
    """CTEs ``name(id, x)``: runs of equal characters cut to five, found by windows."""
    return f"""{name}_c as (select id, unnest(string_split({column}, '')) as ch, generate_subscripts(string_split({column}, ''), 1) as spot from {source}),
{name}_g as (select *, spot - row_number() over (partition by id, ch order by spot) as g from {name}_c),
{name}_r as (select *, row_number() over (partition by id, ch, g order by spot) as r from {name}_g),
{name} as (select id, string_agg(ch, '' order by spot) as x from {name}_r where r <= 5 or ch = {NL} group by id)"""


def processed_tokens(keep: bool, full: bool, lang: str = "cpp") -> str:
    """CTEs after ``tok`` that end in ``out(id, pos, token, tag)``."""
    literal_tags = str(fixed.LITERAL_TAGS[lang][1:])
    lit_source = f"lits as (select id, pos, token as x, tag from tok where tag in {literal_tags} or tag = 'comment')"
    if full:
        stages = whole("lits", "id, pos", "tag = 'comment'", "lit2")
    else:
        stages = (
            "com1 as (select * from lits where tag = 'comment'),\n"
            + light_comment("com1", "id, pos", "com2")
            + f",\nlit2 as (select * from com2 union all select id, pos, "
            f"{replace_all('x', ((chr(10), chr(92) + 'n'), (chr(13), '')))} from lits where tag <> 'comment')"
        )
    dropped = "" if keep else "where tag <> 'comment'"
    plain = replace_all("t.token", (("\n", "NEW_LINE"), ("NEW_LINENEW_LINE", "NEW_LINE")))
    return f"""{lit_source},
{stages},
mixed as (select t.id, t.tag, t.pos as spot, case when l.pos is not null then l.x else {plain} end as token
  from (select * from tok {dropped}) t left join lit2 l on l.id = t.id and l.pos = t.pos),
out as (select id, cast(row_number() over (partition by id order by spot) - 1 as int) as pos, token, tag from mixed where token <> '')"""


# --- Python --------------------------------------------------------------------------------

PY_LEX = (
    r'(?s)\n[ \t]*|\\\n[ \t]*|#[^\n]*|"""[^"]*"""|"[^\n"\\]*(?:\\.[^\n"\\]*)*"|[0-9]+|[\p{L}\p{N}_]+'
    r"|\*\*|[-+*/%&|^=!<>]=|"
) + NOT_WS


def python_tokens(source: str) -> str:
    """CTEs that end in ``pytok(id, pos, token)``.

    Lexemes are numbered by physical line, brackets summed up by windows, and the stack of indentations is a recursive query
    that takes the next statement of every file at each step.
    """
    return f"""pym as (select id, regexp_extract_all({NL} || code, {lit(PY_LEX)}) as m from {source}),
pyu as (select id, unnest(m) as x, generate_subscripts(m, 1) as spot from pym),
pyn as (select *, sum(case when x[1] = {NL} then 1 else 0 end) over w as no,
    sum(case when x in ('(', '[', '{{') then 1 when x in (')', ']', '}}') then -1 else 0 end) over w as depth
  from pyu where x[1] <> chr(92) window w as (partition by id order by spot)),
pyline as (select id, no, max(case when x[1] = {NL} then x end) as head, arg_max(depth, spot) as after,
    list(x order by spot) filter (x[1] <> {NL} and x[1] <> '#') as toks from pyn group by id, no),
pykept as (select id, no, after, toks, coalesce(lag(after) over (partition by id order by no), 0) as before,
    list_reduce([0] || list_transform(string_split(head[2:], ''), lambda c: case c when ' ' then 1 when chr(9) then 8 else 0 end),
      lambda w, c: case c when 8 then (w // 8 + 1) * 8 else w + c end) as width from pyline),
-- a line with nothing but a string is a comment
pysaid as (select * from pykept where len(toks) > 0 and not (len(toks) = 1 and toks[1][1] = '"' and before = 0)),
pystate as (select *, row_number() over (partition by id order by no) as k from pysaid where before = 0),
pystack as (
  select id, cast(0 as bigint) as k, [cast(0 as bigint)] as stack, cast(0 as bigint) as closed, 0 as opened from {source}
  union all
  select s.id, s.k, case when s.width > p.stack[-1] then list_append(p.stack, s.width) else list_filter(p.stack, lambda x: x <= s.width) end,
    len(p.stack) - len(list_filter(p.stack, lambda x: x <= s.width)), case when s.width > p.stack[-1] then 1 else 0 end
  from pystack p join pystate s on s.id = p.id and s.k = p.k + 1),
pyopen as (select s.id, s.no, p.closed, p.opened from pystate s join pystack p on p.id = s.id and p.k = s.k),
pyend as (select id, arg_max(len(stack), k) - 1 as open_blocks, max(k) as k from pystack group by id),
pyrows as (select t.id, t.no, list_transform(range(coalesce(o.closed, 0)), lambda x: 'DEDENT')
    || list_transform(range(coalesce(o.opened, 0)), lambda x: 'INDENT') || t.toks || case when t.after <= 0 then ['NEW_LINE'] else [] end as toks
  from pysaid t left join pyopen o on o.id = t.id and o.no = t.no
  union all select id, 1000000000, list_transform(range(open_blocks), lambda x: 'DEDENT') from pyend),
pyflat as (select id, no, unnest(toks) as x, generate_subscripts(toks, 1) as k from pyrows),
pynum as (select id, row_number() over (partition by id order by no, k) - 1 as pos, x from pyflat),
pystr as (select id, pos, x from pynum where x[1] = '"'),
{whole("pystr", "id, pos", "false", "pylit", fixed.PYTHON_SPECIALS)},
pytok as (select n.id, cast(n.pos as int) as pos, coalesce(l.x, n.x) as token from pynum n left join pylit l on l.id = n.id and l.pos = n.pos)"""


PYTHON_FUNCTIONS = """pydepth as (select *, sum(case token when 'INDENT' then 1 when 'DEDENT' then -1 else 0 end)
    over (partition by id order by pos) as depth from pytok),
pyends as (select d.id, d.pos as s, min(e.pos) as e from pydepth d join pydepth e
    on e.id = d.id and e.pos > d.pos and e.token = 'DEDENT' and e.depth = d.depth where d.token = 'def' group by all),
pyspan as (select * from pyends a where not exists
    (select 1 from pyends o where o.id = a.id and o.s < a.s and o.e >= a.e)),
pytext as (select f.id, f.s, f.e, string_agg(t.token, ' ' order by t.pos) as text, list(t.token order by t.pos) as toks
    from pyspan f join pytok t on t.id = f.id and t.pos between f.s and f.e group by all),
pyfun as (select * from pytext where not (regexp_matches(text, 'print [^(]') or regexp_matches(text, 'raise [\\p{L}\\p{N}_]+ ,')
    or regexp_matches(text, 'except [\\p{L}\\p{N}_]+ ,') or regexp_matches(text, '[^ ]+ = \\p{Nd}+ L')
    or contains(text, '. iterkeys ( )') or contains(text, '. itervalues ( )') or contains(text, '. iteritems ( )')
    or contains(text, 'xrange (') or contains(text, 'imap (')))"""

# --- C++ and Java functions ----------------------------------------------------------------

CPP_FUNCTIONS = f"""a as (select *,
    sum(case token when '{{' then 1 when '}}' then -1 else 0 end) over w as depth,
    lead(token, 1) over w as n1, lead(token, 2) over w as n2, lead(token, 4) over w as n4, lead(token, 5) over w as n5,
    max(case when token in (';', '}}', '{{', {NL}) then pos end) over w as bnd,
    max(case when token in (';', '}}', '{{', {NL}) then pos end) over (partition by id order by pos rows between unbounded preceding and 1 preceding) as before,
    max(case when token in ('class', 'struct') then pos end) over w as head,
    max(pos) over (partition by id) as lastpos, lag(tag) over w as ptag
  from tok window w as (partition by id order by pos)),
c as (select id, coalesce(bnd + 1, 0) as s, pos + case when n1 = '{{' then 1 else 4 end as b, depth as d, lastpos from a
  where token = ')' and ((n1 = '{{' and n2 <> '}}') or (n1 = 'throw' and n4 = '{{' and n5 <> '}}'))),
f as (select c.id, c.s, c.b, c.d, c.lastpos, min(p.pos) as par from c join a p
  on p.id = c.id and p.token = '(' and p.pos between c.s and c.b group by all),
v as (select f.*, p.ptag from f join a p on p.id = f.id and p.pos = f.par
  where p.ptag in ('identifier', 'field_identifier') and f.par > f.s),
ends as (select v.id, v.s, v.b, v.d, v.par, v.ptag, coalesce(min(z.pos), any_value(v.lastpos)) as e from v left join a z
  on z.id = v.id and z.token = '}}' and z.pos > v.b and z.depth = v.d group by all),
span as (select * from ends x where not exists (select 1 from ends o where o.id = x.id and o.s < x.s and o.e >= x.e)),
-- the innermost brace around a span is a class body when its head names a class
opens as (select *, coalesce(head > coalesce(before, -1), false) as is_class from a where token = '{{'),
around as (select s.id, s.s, max_by(o.is_class, o.pos) as in_class from span s join opens o
  on o.id = s.id and o.pos < s.s and o.depth = s.d group by all),
words as (select s.id, s.s, s.e, s.ptag, coalesce(r.in_class, false) as in_class,
    bool_or(t.token = 'static' and t.pos < s.b) as is_static, bool_or(t.token = '::' and t.pos < s.par) as is_scoped,
    string_agg(case when t.tag = 'comment' then {strip("t.token")} || ' ENDCOM' else t.token end, ' ' order by t.pos) as text
  from span s left join around r on r.id = s.id and r.s = s.s join tok t on t.id = s.id and t.pos between s.s and s.e group by all)"""


def clean_preprocessor(x: str) -> str:
    for pattern in fixed.PREPROCESSOR_PATTERNS:
        x = regex(x, pattern, "")
    return strip(replace_all(x, [(w, "") for w in fixed.PREPROCESSOR_WORDS]))


def cpp_functions(prepare: str = "code") -> str:
    text = replace(clean_preprocessor(regex("text", fixed.HEREDOC_PATTERN, "")), "\n", "ENDCOM")
    return f"""prepared as (select id, {strip(prepare)} as code from cpp_file),
{lex("prepared")},
{CPP_FUNCTIONS},
cleaned as (select id, s, e, {text} as text,
  case when is_static or not (is_scoped or in_class or ptag = 'field_identifier') then 'standalone' else 'class' end as kind from words),
cppfun as (select *, list_filter(regexp_split_to_array(text, ' +'), lambda t: t <> '') as toks from cleaned where text[1] <> '#')"""


JAVA_FUNCTIONS = f"""tok as (select id, cast(unnest(range(len(m))) as int) as pos, unnest(m) as token from
    (select id, list_filter(regexp_split_to_array(code, '{WS}+'), lambda t: t <> '') as m from java_tokens)),
solid as (select *, lead(token, 1) over w as n1, lead(token, 3) over w as n3 from tok where token <> 'NEW_LINE'
    window w as (partition by id order by pos)),
deep as (select *, sum(case token when '{{' then 1 when '}}' then -1 else 0 end) over w as depth,
    max(case when token in (';', '}}', '{{', '*/', 'ENDCOM', 'NEW_LINE') then pos end) over w as bnd,
    max(pos) over (partition by id) as lastpos from tok window w as (partition by id order by pos)),
heads as (select d.id, d.pos as p, d.bnd, d.depth as d, d.lastpos, b.token as bt from deep d
    join solid s on s.id = d.id and s.pos = d.pos and s.token = ')' and (s.n1 = '{{' or (s.n1 = 'throws' and s.n3 = '{{'))
    left join tok b on b.id = d.id and b.pos = d.bnd),
begins as (select h.id, h.p, h.d, h.lastpos, coalesce(
      case when h.bt = '*/' then (select max(pos) from tok t where t.id = h.id and t.token = '/*' and t.pos < h.bnd)
           when h.bt = 'ENDCOM' then (select max(pos) from tok t where t.id = h.id and t.token = '//' and t.pos < h.bnd) end,
      h.bnd + 1, 0) as s from heads h),
ends as (select g.id, g.s, coalesce(min(z.pos), any_value(g.lastpos)) as e from begins g left join deep z
    on z.id = g.id and z.token = '}}' and z.pos > g.p and z.depth = g.d group by g.id, g.s, g.p),
span as (select * from ends x where not exists (select 1 from ends o where o.id = x.id and o.s < x.s and o.e >= x.e)),
javafun as (select s.id, s.s, s.e, list(t.token order by t.pos) as toks
    from span s join tok t on t.id = s.id and t.pos between s.s and s.e group by all)"""

JAVA_TEXT_FUNCTIONS = f"""{lex("java_file", lang="java")},
{processed_tokens(True, True, "java")},
jn as (select *, lag(token, 1) over w as p1, lag(token, 2) over w as p2, lag(token, 4) over w as p4, lead(token, 1) over w as n1,
    sum(case when tag <> 'comment' and token = '(' then 1 when tag <> 'comment' and token = ')' then -1 else 0 end) over w as paren
  from out window w as (partition by id order by pos)),
jopen as (select id, pos, paren from jn where tag <> 'comment' and token = '(' and regexp_matches(p1, '^[A-Za-z]') and (p2 = '@' or (p2 = '.' and p4 in ('@', '.')))),
jnote as (select o.id, o.pos as s, min(c.pos) as e from jopen o join jn c on c.id = o.id and c.tag <> 'comment' and c.token = ')' and c.pos > o.pos
    and c.paren = o.paren - 1 group by all),
jfree as (select n.* from jn n left join jnote a on a.id = n.id and n.pos between a.s and a.e where a.id is null),
jb as (select *, max(case when tag <> 'comment' and token in (';', '}}', '{{') then pos + 1 when tag = 'comment' and paren = 0 then pos end) over w as bnd,
    sum(case when tag = 'comment' then 0 when token = '{{' then 1 when token = '}}' then -1 else 0 end) over w as depth,
    lead(pos) over w as nxt, max(pos) over (partition by id) as lastpos
  from jfree window w as (partition by id order by pos)),
jstop as (select *, min(case when tag <> 'comment' and token in ('{{', ';') then pos end) over (partition by id order by pos rows between 1 following and unbounded following) as body from jb),
jheads as (select h.id, h.pos, h.body, coalesce(h.bnd, 0) as s, h.depth as d, h.lastpos from jstop h join jn b on b.id = h.id and b.pos = h.body
  where h.tag <> 'comment' and h.token = ')' and h.n1 in ('{{', 'throws') and b.token = '{{'),
jends as (select h.id, h.s, coalesce(min(z.pos), any_value((select max(pos) from jn where jn.id = h.id))) as e from jheads h left join jb z
    on z.id = h.id and z.tag <> 'comment' and z.token = '}}' and z.pos > h.body and z.depth = h.d group by h.id, h.s, h.pos),
jspan as (select * from jends x where not exists (select 1 from jends o where o.id = x.id and o.s < x.s and o.e >= x.e)),
jfun as (select s.id, s.s, s.e, string_agg(t.token, ' ' order by t.pos) as text, list(t.token order by t.pos) as toks
    from jspan s join out t on t.id = s.id and t.pos between s.s and s.e group by all)"""

# --- rendering -----------------------------------------------------------------------------


def indented(source: str, name: str) -> str:
    """CTEs ``name(id, text)`` from ``source(id, lines)``; the depth is a sum that is lifted wherever it would fall below zero."""
    return f"""{name}_l as (select id, {strip("line")} as line, no from (select id, unnest(lines) as line, generate_subscripts(lines, 1) as no from {source})),
{name}_d as (select *, case when starts_with(line, 'CB_') then -1 when ends_with(line, 'OB_') then 1 else 0 end as d from {name}_l),
{name}_w as (select *, sum(d) over (partition by id order by no) as total from {name}_d),
{name}_s as (select *, total - least(0, min(total) over (partition by id order by no)) as after from {name}_w),
{name} as (select id, string_agg(repeat('  ', cast(after - case when d > 0 then 1 else 0 end as int)) || line, {NL} order by no) as text from {name}_s group by id)"""


def oracle_sql() -> dict[str, str]:
    sql: dict[str, str] = {}

    # sources and columns
    delimited = f"string_split(regexp_replace({NL} || code, '\\n[^\\n]*-{{25}}[^\\n]*', chr(1), 'g'), chr(1))"
    block_rows = f"""{cte("block_file")},
pieces as (select id, unnest({delimited}) as block, generate_subscripts({delimited}, 1) as k from block_file),
lined as (select id, cast(k - 1 as int) as block_no, list_filter(list_transform(
  string_split(block, {NL}), lambda t: {strip("t")}), lambda t: t <> '') as l from pieces),
parsed as (select id, block_no, array_to_string(l[2:-2], {NL}) as code, try_cast(l[-1] as int) as label, l[-1] as label_text from lined where len(l) >= 3)"""
    sql["s2_delimited_blocks"] = with_(block_rows, select="select id, block_no, code, label from parsed where label is not null")
    sql["p6_drop_blank_lines"] = with_(block_rows, select=f"select id, block_no, array_to_string(l, {NL}) as lines from lined")
    sql["p7_minimum_block_size"] = with_(block_rows, select="select id, count(*) as n_blocks from parsed group by id")
    sql["p8_rejected_labels"] = with_(block_rows, select="select id, block_no, code, label_text from parsed where label is null")
    sql["s2_block_files"] = with_(
        block_rows, select="select label, code, count(*) as n from parsed where label is not null group by label, code"
    )
    sql["s1_labelled_json"] = (
        "select p_size % 2 as label, p_name as code, count(*) as n, cast(sum(p_size) as bigint) as size from part group by 1, 2"
    )
    sql["s7_source_origin"] = (
        "select 'documents' as vul_type, doc_id as id, text as code from documents "
        "union all select 'pages', page_id, html from pages"
    )
    sql["p1_drop_columns"] = "select doc_id, text from documents"
    sql["p2_rename_column"] = "select doc_id, quality as label, toxic from labels"
    sql["p3_cast_label"] = "select p_partkey as id, try_cast(p_partkey as tinyint) as label from part"
    sql["p4_constant_label"] = "select page_id as id, url, 1 as label from pages"
    sql["p5_rewrite_column"] = with_(
        cte("cpp_file"), f"a as (select id, {n1('code')} as code from cpp_file)",
        f"b as (select id, {n2('code')} as code from a)", select=f"select id, {n3('code')} as code from b",
    )
    sql["p9_choose_columns"] = "select page_id as id, html as code from pages"
    sql["p10_keep_missing_labels"] = (
        "select d.doc_id as id, l.quality as label from documents d left join labels l on l.doc_id = d.doc_id"
    )
    sql["u1_union_classes"] = (
        "select doc_id, lang, case when doc_id in (select doc_id from labels) then 1 else 0 end as label from documents"
    )
    sql["u2_union_files"] = " union all ".join(
        f"select {key} as id, {text} as code, '{name}' as vul_type from {name}"
        for name, key, text in (
            ("documents", "doc_id", "text"), ("pages", "page_id", "html"),
            ("conversations", "conv_id", "text"), ("benchmark", "item_id", "text"),
        )
    )

    # cleaning
    code_cpp = cte("code_cpp")
    for name, expr in (("n1_remove_comments", n1("code")), ("n2_remove_trailing_space", n2("code")), ("n3_remove_empty_lines", n3("code"))):
        sql[name] = with_(code_cpp, select=f"select id, {expr} as code from code_cpp")
    normalized = (
        f"na as (select id, label, {n1('code')} as code from code_cpp)",
        f"nb as (select id, label, {n2('code')} as code from na)",
        f"clean as (select id, label, {n3('code')} as code from nb)",
    )
    sql["n4_normalize"] = with_(code_cpp, *normalized, select="select id, code from clean")
    sql["n5_remove_carriage_returns"] = with_(code_cpp, select="select id, code from code_cpp")

    # lexing
    cpp_lex = (cte("cpp_file"), lex("cpp_file"))
    sql["l1_lex_cpp"] = with_(*cpp_lex, select="select id, pos, token from tok")
    sql["l1_lex_documents"] = with_(DOCUMENTS, lex("docs"), select="select id, pos, token from tok")
    sql["l1_lex_pages"] = with_(PAGES, lex("docs"), select="select id, pos, token from tok")
    sql["l2_tags_cpp"] = with_(*cpp_lex, select="select id, pos, token, tag from tok")
    sql["l2_tags_java"] = with_(cte("java_file"), lex("java_file", lang="java"), select="select id, pos, token, tag from tok")
    sql["l2_tag_counts"] = with_(
        code_cpp, *normalized, lex("clean", keys="id, label"),
        select="select label, tag, count(*) as n from tok group by label, tag",
    )
    out = "select id, pos, token from out"
    sql["l3_text_tokens"] = with_(*cpp_lex, processed_tokens(False, True), select=out)
    sql["l3_text_tokens_with_comments"] = with_(*cpp_lex, processed_tokens(True, True), select=out)
    sql["l3_text_tokens_java"] = with_(cte("java_file"), lex("java_file", lang="java"), processed_tokens(True, True, "java"), select=out)
    sql["l3_text_tokens_light"] = with_(*cpp_lex, processed_tokens(True, False), select=out)
    pytok = "select id, pos, token from pytok"
    sql["l4_lex_python_functions"] = with_(cte("code_py"), python_tokens("code_py"), select=pytok)
    py_files = (cte("py_file"), python_tokens("py_file"))
    sql["l4_lex_python_files"] = with_(*py_files, select=pytok)
    joined = "string_agg(token, ' ' order by pos) as tokens, string_agg(tag, ' ' order by pos) as tags"
    sql["l5_tokenized_corpus"] = with_(
        code_cpp, lex("code_cpp", keys="id, label"), select=f"select id, label, {joined} from tok group by id, label"
    )
    sql["l6_language_dispatch"] = with_(
        code_cpp, cte("java_file"), cte("code_py"),
        lex("code_cpp", name="ctok"), lex("java_file", lang="java", name="jtok"), python_tokens("code_py"),
        select="select id, 'cpp' as lang, pos, token from ctok union all select id, 'java', pos, token from jtok "
        "union all select id, 'python', pos, token from pytok",
    )
    sql["l7_long_and_wide"] = with_(code_cpp, lex("code_cpp"), select=f"select id, {joined} from tok group by id")
    blanked = "blank_some as (select id, case when id % 7 = 0 then chr(10) else code end as code from code_cpp)"
    sql["l7_texts_without_tokens"] = with_(
        code_cpp, blanked, lex("blank_some"), f"wide as (select id, {joined} from tok group by id)",
        select="select id, coalesce(tokens, '') as tokens, coalesce(tags, '') as tags from blank_some left join wide using (id)",
    )
    bad = "rtrim(code, ' ') || chr(10) || 'if x:' || chr(10) || '        y = 1' || chr(10) || '    z = 2' || chr(10)"
    tag = f"""case when token in ('NEW_LINE', 'INDENT', 'DEDENT') then token when regexp_full_match(token, '[\\p{{L}}_][\\p{{L}}\\p{{N}}_]*') then 'identifier'
      when regexp_matches(token, '^\\.?[0-9]') then 'number_literal' when regexp_matches(token, '(?s)^[A-Za-z]{{0,2}} ?["\'\'].+') then 'string' else token end"""
    sql["l2_tags_python"] = with_(*py_files, select=f"select id, pos, token, {tag} as tag from pytok")
    sql["l4_rejected_sources"] = with_(
        cte("code_py"),
        select=f"select id, cast(length(case when id % 5 = 0 then {bad} else code end) as int) as chars, "
        "case when id % 5 = 0 then 'rejected' else 'accepted' end as kind from code_py",
    )
    c_marked, py_marked = t2("code"), t2("code", fixed.PYTHON_SPECIALS)
    sql["l8_special_tokens"] = with_(
        cte("cpp_file"),
        select=f"select id, {c_marked} as c_marked, {t8(c_marked)} as c_restored, {py_marked} as py_marked, "
        f"{t8(py_marked, fixed.PYTHON_SPECIALS)} as py_restored from cpp_file",
    )

    # literals
    def text_of(source: str, expr: str) -> str:
        return with_(cte(source), select=f"select id, {expr} as text from {source}")

    sql["t1_show_white_space"] = text_of("block_comment", t1("code"))
    sql["t2_mark_specials"] = text_of("literal", t2("code"))
    sql["t3_collapse_spaces"] = text_of("block_comment", t3("code"))
    sql["t4_cap_runs"] = with_(cte("block_comment"), capped("block_comment", "code", "cap"), select="select id, x as text from cap")
    sql["t5_drop_contentless"] = text_of("line_comment", f"case when {t5('code')} then '' else code end")
    sql["t6_mark_comment_end"] = with_(
        cte("line_comment"), f"m as (select id, {t2(t1('code'))} as x from line_comment)",
        select=f"select id, {t6('x')} as text from m",
    )
    sql["t7_split_words"] = with_(DOCUMENTS, select=f"select id, {t7('code')} as text from docs")
    sql["t8_restore_specials"] = text_of("literal", t8(t2("code")))
    sql["t9_rejoin_prefix"] = with_(
        cte("literal"), f"m as (select id, {t1('code')} as x from literal)", select=f"select id, {t9('x')} as text from m"
    )
    sql["t10_literal"] = with_(
        cte("literal"), "src as (select id, code as x from literal)", whole("src", "id", "false", "w"),
        select="select id, x as text from w",
    )
    sql["t10_pages"] = with_(
        PAGES, "src as (select id, code as x from docs)", whole("src", "id", "false", "w"), select="select id, x as text from w"
    )
    for kind in ("block_comment", "line_comment"):
        sql[f"t10_{kind}"] = with_(
            cte(kind), f"squeezed as (select id, {t3('code')} as code from {kind})", capped("squeezed", "code", "cap"),
            whole("cap", "id", "true", "w"), select="select id, x as text from w",
        )
    sql["t11_light_literal"] = text_of("literal", replace_all(f"code || {NL}", (("\n", "\\n"), ("\r", ""))))
    sql["t11_light_comment"] = with_(
        cte("block_comment"), f"squeezed as (select id, {t3('code')} as code from block_comment)",
        capped("squeezed", "code", "cap"), light_comment("cap", "id", "w"), select="select id, x as text from w",
    )
    pieces = (DOCUMENTS, "src as (select id, code as x from docs)", whole("src", "id", "false", "w", ()))
    sql["t12_tokenize_string"] = with_(
        *pieces,
        select="select id, cast(generate_subscripts(string_split(x, ' '), 1) - 1 as int) as pos, "
        "unnest(string_split(x, ' ')) as token from w",
    )
    sql["t13_detokenize_string"] = with_(
        *pieces, select=f"select id, {replace_all('x', ((' ', ''), ('▁', ' ')))} as text from w"
    )

    # functions
    cpp = (cte("cpp_file"), cpp_functions())
    java = (cte("java_tokens"), JAVA_FUNCTIONS)
    py = (*py_files, PYTHON_FUNCTIONS)
    at = "cast(s as int) as start_pos"
    ends = f"{at}, cast(e as int) as end_pos"
    name = "toks[list_position(toks, '(') - 1]"
    sql["f1_cpp_spans"] = with_(cte("cpp_file"), lex("cpp_file"), CPP_FUNCTIONS, select=f"select id, {ends} from span")
    sql["f2_cpp_kind"] = with_(*cpp, select=f"select id, {at}, kind from cppfun")
    sql["f3_java_spans"] = with_(*java, select=f"select id, {ends} from javafun")
    sql["f4_java_kind"] = with_(
        *java,
        select=f"select id, {at}, case when list_contains(toks[1:list_position(toks, '{{') - 1], 'static') "
        "then 'standalone' else 'class' end as kind from javafun",
    )
    sql["f5_python_spans"] = with_(*py, select=f"select id, {ends} from pyspan")
    sql["f6_python_kind"] = with_(
        *py,
        select=f"select id, {at}, case when toks[list_position(toks, '(') + 1] = 'self' then 'class' else 'standalone' end as kind from pyfun",
    )
    sql["f7_python2_filter"] = with_(*py, select=f"select id, {at}, text from pyfun")
    sql["f8_clean_preprocessor"] = text_of("preprocessed", clean_preprocessor("code"))
    sql["f9_heredoc_marks"] = text_of("preprocessed", regex("code", fixed.HEREDOC_PATTERN, ""))
    sql["f10_function_text"] = with_(*cpp, select=f"select id, {at}, text from cppfun")
    flat = r"regexp_replace(code, '^[^\n]*\n[^\n]*\n', '#endif ')"
    sql["f11_preprocessor_led"] = with_(
        cte("cpp_file"), cpp_functions(flat), select=f"select id, {at}, {name} as name from cppfun"
    )
    java_text = (cte("java_file"), JAVA_TEXT_FUNCTIONS)
    plain_text = f"regexp_replace(text, {lit(fixed.ANNOTATION_PATTERN)}, '')"
    sql["f3_java_from_text"] = with_(
        *java_text,
        select=f"select id, {ends}, case when list_contains(toks[1:list_position(toks, '{{') - 1], 'static') then 'standalone' else 'class' end as kind, "
        f"{plain_text} as text from jfun",
    )
    sql["f12_remove_annotation"] = with_(*java_text, select=f"select id, {at}, {plain_text} as text from jfun")
    sql["f13_function_name"] = (
        f"select * from ({with_(*cpp, select=f'select id, {lit("cpp")} as lang, {at}, {name} as name from cppfun')}) "
        f"union all select * from ({with_(*java, select=f'select id, {lit("java")} as lang, {at}, {name} as name from javafun')})"
    )
    def named(parts, source: str, lang: str, kind: str, what: str) -> str:
        return with_(*parts, select=f"select id, '{lang}' as lang, {ends}, {kind} as kind, {what} as name from {source}")

    static = "case when list_contains(toks[1:list_position(toks, '{') - 1], 'static') then 'standalone' else 'class' end"
    own = "case when toks[list_position(toks, '(') + 1] = 'self' then 'class' else 'standalone' end"
    java_name = f"list_filter(regexp_split_to_array({plain_text}, ' +'), lambda t: t <> '')"
    mixed = (
        named(cpp, "cppfun", "cpp", "kind", name),
        named(java_text, "jfun", "java", static, f"{java_name}[list_position({java_name}, '(') - 1]"),
        named(py, "pyfun", "python", own, "toks[list_position(toks, 'def') + 1]"),
    )
    sql["f13_mixed_languages"] = " union all ".join(f"select * from ({part})" for part in mixed)
    sql["f14_python_function_name"] = with_(
        *py, select=f"select id, {at}, toks[list_position(toks, 'def') + 1] as name from pyfun"
    )
    sql["f15_arguments"] = with_(
        *cpp,
        "ftok as (select id, s, cast(unnest(range(len(toks))) as int) as k, unnest(toks) as t from cppfun)",
        "fdep as (select *, sum(case t when '(' then 1 when ')' then -1 else 0 end) over (partition by id, s order by k) as d from ftok)",
        "fopen as (select id, s, min(k) as o from fdep where t = '(' group by all)",
        "fclose as (select o.id, o.s, o.o, min(c.k) as c from fopen o join fdep c on c.id = o.id and c.s = o.s and c.t = ')' and c.d = 0 and c.k > o.o group by all)",
        "fargs as (select f.id, f.s, coalesce(string_agg(t.t, ' ' order by t.k), '') as inner_text from fclose f "
        "left join ftok t on t.id = f.id and t.s = f.s and t.k > f.o and t.k < f.c group by all)",
        "fone as (select id, s, inner_text, generate_subscripts(string_split(inner_text, ','), 1) - 1 as arg_no, unnest(string_split(inner_text, ',')) as arg from fargs)",
        "fbr as (select *, array_to_string(regexp_extract_all(arg, '\\[ \\]'), ' ') as br from fone)",
        f"fw as (select *, string_split({regex(strip('case when br = ' + lit('') + ' then arg else replace(arg, br, ' + lit('') + ') end'), ' +', ' ')}, ' ') as w from fbr)",
        select=f"select id, {at}, cast(arg_no as int) as arg_no, "
        "case when inner_text = '' then 'None' else array_to_string(list_append(w[1:len(w) - 1], br), ' ') end as arg_type, "
        "case when inner_text = '' then 'None' else w[-1] end as arg_name from fw",
    )

    # rendering
    decode = replace_all(
        t2(replace_all("token", (("STRNEWLINE", "\n"), ("TABSYMBOL", "\t")))), ((" ", ""), ("▁", " "))
    )
    marks = (
        ("\n", "NEW_LINE"), ('} "', 'CB_ "'), ('" {', '" OB_'), ("} ;", "CB_COLON"), ("} ,", "CB_COMA"), ("}", "CB_"), ("{", "OB_"),
    )
    close_up = (
        ("CB_COLON", "};"), ("CB_COMA", "},"), ("CB_", "}"), ("OB_", "{"),
        ("> > >", ">>>"), ("<< <", "<<<"), ("> >", ">>"), ("< <", "<<"),
    )
    shown = decode.replace("token", f"replace({regex('token', ' *ENDCOM *$', '')}, 'ENDCOM', {NL})")
    for lang, source in (("cpp", "cpp_file"), ("java", "java_file")):
        literal_tags = str(fixed.LITERAL_TAGS[lang][1:])
        last = regex("text", "#define (.*) [(]", "#define " + chr(92) + "1(") if lang == "cpp" else "text"
        sql[f"r1_render_{lang}"] = with_(
            cte(source), lex(source, lang=lang), processed_tokens(True, True, lang),
            f"pieced as (select id, pos, case when tag = 'comment' then {shown} || {NL} when tag in {literal_tags} then {decode} "
            f"when token in (';', '{{', '}}') then token || ' ' || {NL} else token end as piece from out)",
            f"marked as (select id, {t8(replace_all('string_agg(piece, chr(32) order by pos)', marks))} as text from pieced group by id)",
            "split as (select id, string_split(text, 'NEW_LINE') as lines from marked)",
            indented("split", "laid"),
            f"closed as (select id, {replace_all('text', close_up)} as text from laid)",
            select=f"select id, {last} as text from closed",
        )
    sql["r2_join_macro"] = text_of(
        "preprocessed", regex("replace(code, '# define', '#define')", r"#define (.*) \(", r"#define \1(")
    )
    sql["r3_indent_lines"] = with_(
        cte("cpp_file"),
        f"src as (select id, string_split(replace(replace(code, '{{', 'OB_' || {NL}), '}}', {NL} || 'CB_'), {NL}) as lines from cpp_file)",
        indented("src", "laid"), select="select id, text from laid",
    )
    prefixes = [q for p in fixed.PYTHON_STRING_PREFIXES for q in (p, p.upper())]
    py_close = [(". ", "."), (" .", "."), ("import.", "import ."), ("from.", "from .")]
    py_close += [pair for p in prefixes for pair in ((f" {p} '", f" {p}'"), (f' {p} "', f' {p}"'))]
    py_close += [("> >", ">>"), ("< <", "<<")]
    py_literal = replace_all("t", (("STRNEWLINE", "\n"), ("TABSYMBOL", "\t"), (" ", ""), ("SPACETOKEN", " ")))
    sql["r4_render_python"] = with_(
        *py_files,
        f"joined as (select id, {replace_all('string_agg(token, chr(32) order by pos)', (('ENDCOM', 'NEW_LINE'), ('▁', 'SPACETOKEN')))} as code from pytok group by id)",
        f"lined as (select id, {strip('line')} as line, no from (select id, unnest(string_split(code, 'NEW_LINE')) as line, "
        "generate_subscripts(string_split(code, 'NEW_LINE'), 1) as no from joined))",
        "stepped as (select *, case when starts_with(line, 'INDENT ') then 1 when starts_with(line, 'DEDENT') "
        "then -len(regexp_extract_all(line, 'DEDENT')) else 0 end as d from lined)",
        "summed as (select *, sum(d) over (partition by id order by no) as depth from stepped)",
        f"laid as (select id, string_agg(repeat('    ', cast(depth as int)) || {strip('replace(replace(line, ' + lit('INDENT ') + ', ' + lit('') + '), ' + lit('DEDENT') + ', ' + lit('') + ')')}, {NL} order by no) as text from summed group by id)",
        f"decoded as (select id, array_to_string(list_transform(regexp_extract_all(text, {lit('(?s)"[^"]*"|[^"]+')}), lambda t: case when t[1] = '\"' then {py_literal} else t end), '') as text from laid)",
        select=f"select id, {replace_all('text', py_close)} as text from decoded",
    )

    sql["r1_render_mixed"] = " union all ".join(
        f"select id, '{lang}' as lang, text from ({sql[part]})" for lang, part in (("cpp", "r1_render_cpp"), ("java", "r1_render_java"), ("python", "r4_render_python"))
    )

    # data set assembly
    bucket = f"(('0x' || substr(md5('{SPLIT_SEED}' || cast(id as varchar)), 1, 8))::bigint % 100)"
    split = f"case when {bucket} < 80 then 'train' when {bucket} < 90 then 'validation' else 'test' end"
    split_docs = f"(select id, text, {split} as split from (select doc_id as id, text from documents))"
    sql["s3_presplit_table"] = f"select id, text, split from {split_docs}"
    sql["s4_read_saved_split"] = f"select id, text, split from {split_docs} where split = 'validation'"
    sql["s5_save_splits"] = (
        f"select split, count(*) as n, cast(sum(length(text)) as bigint) as chars from {split_docs} group by split"
    )
    sql["s6_build_once"] = f"select id, split from {split_docs}"
    sql["d1_hash_split"] = f"select id, {split} as split from (select doc_id as id from documents)"
    sql["d2_exact_split"] = f"""with r as (select doc_id as id,
    row_number() over (order by md5('{SPLIT_SEED}' || cast(doc_id as varchar))) as k, count(*) over () as n from documents),
c as (select *, cast(ceil(n / 5.0) as bigint) as held from r)
select id, case when k <= n - held then 'train' when k <= n - cast(ceil(held / 2.0) as bigint) then 'validation' else 'test' end as split from c"""
    named = "coalesce(cast(case when id % 9 <> 0 then id end as varchar), chr(0))"
    gaps = f"(select id, md5('{SPLIT_SEED}' || {named}) as digest from (select doc_id as id from documents))"
    gap_bucket = "(('0x' || substr(digest, 1, 8))::bigint % 100)"
    sql["d1_hash_split_null_keys"] = (
        f"select id, case when {gap_bucket} < 80 then 'train' when {gap_bucket} < 90 then 'validation' else 'test' end as split from {gaps}"
    )
    sql["d2_exact_split_null_keys"] = f"""with r as (select id, digest, row_number() over (order by digest) as k, count(*) over () as n from {gaps}),
c as (select *, cast(ceil(n / 5.0) as bigint) as held from r),
e as (select max(digest) filter (where k <= n - held) as train_end,
    max(digest) filter (where k <= n - cast(ceil(held / 2.0) as bigint)) as validation_end from c)
select id, case when digest <= train_end then 'train' when digest <= validation_end then 'validation' else 'test' end as split from c, e"""
    labelled = (
        "labelled as (select d.doc_id as id, d.text as code, d.source, l.quality as label "
        "from documents d left join labels l on l.doc_id = d.doc_id)"
    )
    doc_tok = (labelled, lex("labelled"))
    cut = f"from tok where pos < {SEQUENCE_LIMIT} group by id"
    sql["d3_truncate"] = with_(
        *doc_tok,
        "short as (select id, cast(count(*) as int) as n, string_agg(token, ' ' order by pos) as tokens " + cut + ")",
        select="select l.id, coalesce(n, 0) as n, coalesce(tokens, '') as tokens from labelled l left join short s on s.id = l.id",
    )
    sql["d4_typed_labels"] = (
        "select p_partkey as id, cast(p_size as varchar) as as_text, p_size as strict, "
        "try_cast(substr(p_brand, 7) as int) as lenient, try_cast(p_type as int) as not_a_label from part"
    )
    sql["d5_pair_tokens"] = with_(
        code_cpp, lex("code_cpp"),
        select="select id, pos, token, tag from (select *, max(pos) over (partition by id) as last from tok) where pos <= last - id % 3",
    )
    terms = (
        "entries as (select 'tokens' as namespace, token as term from tok union all select 'tags', tag from tok "
        "union all select 'labels', cast(label as varchar) from labelled where label is not null)"
    )

    def vocabulary(min_count: int) -> str:
        return (
            f"counted as (select namespace, term, count(*) as n from entries group by all having count(*) >= {min_count}),\n"
            "vocab as (select namespace, term, n, cast(row_number() over (partition by namespace order by n desc, term) - 1 "
            "+ case when namespace = 'labels' then 0 else 2 end as int) as term_id from counted)"
        )

    sql["d6_vocabulary"] = with_(*doc_tok, terms, vocabulary(1), select="select namespace, term, n, term_id from vocab")
    encoded = with_(
        *doc_tok, terms, vocabulary(2),
        select="select id, pos, coalesce(a.term_id, 1) as token_id, coalesce(b.term_id, 1) as tag_id from tok "
        "left join vocab a on a.namespace = 'tokens' and a.term = token left join vocab b on b.namespace = 'tags' and b.term = tag",
    )
    sql["d7_encode"] = encoded
    sql["d7_encode_rare_terms"] = encoded
    sql["d7_encode_filtered_vocabulary"] = with_(
        *doc_tok,
        "entries as (select 'tokens' as namespace, token as term from tok join labelled using (id) where source = 'src0' "
        "union all select 'tags', tag from tok join labelled using (id) where source = 'src0')",
        vocabulary(1), "kept as (select * from vocab where term_id % 3 <> 0)",
        select="select id, pos, coalesce(a.term_id, 1) as token_id, coalesce(b.term_id, 1) as tag_id from tok "
        "left join kept a on a.namespace = 'tokens' and a.term = token left join kept b on b.namespace = 'tags' and b.term = tag",
    )
    counts = (
        "count(*) filter (where label <> 0) as vulnerable, count(*) filter (where label = 0) as clean"
    )
    sql["d8_class_counts"] = with_(
        labelled, f"rows_ as (select *, {split} as split from labelled)",
        select=f"select vul_type, split, grouping(vul_type) = 1 as by_split, {counts} "
        "from (select *, nullif(source, 'src3') as vul_type from rows_) group by grouping sets ((vul_type), (split))",
    )
    sql["d9_training_rows"] = with_(
        labelled, f"chosen as (select * from labelled where {split} = 'train')", lex("chosen"),
        f"short as (select id, {joined} {cut})",
        select="select c.id, cast(label as varchar) as label, coalesce(tokens, '') as tokens, coalesce(tags, '') as tags "
        "from chosen c left join short s on s.id = c.id",
    )
    corpus = (
        code_cpp,
        f"nr as (select id, label, code as raw, {n1('code')} as code from code_cpp)",
        f"ns as (select id, label, raw, {n2('code')} as code from nr)",
        f"clean as (select id, label, raw, {n3('code')} as code from ns)",
        lex("clean"),
        f"wide as (select id, {joined} from tok group by id)",
        f"built as (select c.id as no, c.code, md5(raw) as id, coalesce(tokens, '') as tokens, coalesce(tags, '') as tags from clean c left join wide w on w.id = c.id)",
    )
    sql["corpus_reveal"] = with_(*corpus, select=f"select code, cast(no % 2 as int) as label, {split} as split, tokens, tags from built")
    sql["corpus_codexglue"] = with_(
        *corpus,
        select="select code as func, cast(no % 2 as int) as label, "
        "case no % 3 when 0 then 'train' when 1 then 'validation' else 'test' end as split, tokens, tags from built",
    )
    of_file = "case id % 4 " + " ".join(f"when {at} then '{name}'" for at, name in enumerate(fixed.SYSEVR_FILES)) + " end"
    sources = f"sources as (select *, {of_file} as vul_type, id * 100 + block_no as no from parsed)"
    sql["corpus_sysevr"] = with_(
        block_rows, sources,
        f"nr as (select no as id, vul_type, label, code as raw, {n1('code')} as code from sources where label is not null)",
        f"ns as (select id, vul_type, label, raw, {n2('code')} as code from nr)",
        f"clean as (select id, vul_type, label, raw, {n3('code')} as code from ns)",
        lex("clean"),
        f"wide as (select id, {joined} from tok group by id)",
        "built as (select vul_type, c.code, label, md5(raw) as id, coalesce(tokens, '') as tokens, coalesce(tags, '') as tags from clean c left join wide w on w.id = c.id)",
        select=f"select vul_type, code, label, {split} as split, tokens, tags, 'accepted' as kind from built "
        "union all select vul_type, code, null, null, null, null, 'rejected' from sources where label is null",
    )
    sql["corpus_sysevr_counts"] = with_(
        block_rows, sources,
        select="select vul_type, case when label is null then 'rejected' else 'accepted' end as kind, count(*) as n from sources group by all",
    )
    short_tok = f"string_agg(token, ' ' order by pos) filter (where pos < {SEQUENCE_LIMIT}) as tokens, string_agg(tag, ' ' order by pos) filter (where pos < {SEQUENCE_LIMIT}) as tags"
    cut_corpus = (*corpus, f"cut as (select id as no, {short_tok} from tok group by id)")
    sql["d9_read_saved_split"] = with_(
        *cut_corpus,
        select=f"select cast(no % 2 as int) as label, coalesce(c.tokens, '') as tokens, coalesce(c.tags, '') as tags from built left join cut c using (no) where {split} = 'train'",
    )
    sql["d9_read_saved_split_text_labels"] = with_(
        *corpus, select=f"select cast(no % 2 as varchar) as label, tokens, tags from built where {split} = 'validation'"
    )
    sql["udf1_map_batches"] = f"select doc_id as id, cast(length(text) - length(replace(text, {NL}, '')) + 1 as bigint) as n_lines from documents"
    sql["udf2_plugged_language"] = with_(
        DOCUMENTS,
        f"m as (select id, regexp_extract_all(code, {lit(NOT_WS + '+')}) as m from docs)",
        select="select id, cast(generate_subscripts(m, 1) - 1 as int) as pos, unnest(m) as token, 'word' as tag from m",
    )
    word_rows = f"""{DOCUMENTS},
m as (select id, regexp_extract_all(code, {lit(NOT_WS + '+')}) as m from docs),
w as (select id, generate_subscripts(m, 1) - 1 as pos, unnest(m) as token from m),
e as (select *, sum(case when token like '%.' then 1 else 0 end) over (partition by id order by pos rows between unbounded preceding and 1 preceding) as no from w)"""
    sql["udf2_plugged_functions"] = with_(
        word_rows,
        select="select id, cast(min(pos) as int) as start_pos, cast(max(pos) as int) as end_pos, arg_min(token, pos) as name, "
        "cast(length(string_agg(token, ' ' order by pos)) as int) as chars from e group by id, coalesce(no, 0) having arg_max(token, pos) like '%.'",
    )
    sql["udf2_plugged_rendering"] = with_(
        DOCUMENTS, select=f"select id, array_to_string(regexp_extract_all(code, {lit(NOT_WS + '+')}), '_') as text from docs"
    )
    return sql
