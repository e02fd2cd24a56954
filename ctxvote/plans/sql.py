"""DuckDB statements: the same results from the same tables, put together from named parts."""

from __future__ import annotations

from ..functions.text import KEPT_TOKENS, KEYWORDS, PREFIXES
from ..functions.windows import SIZES


def _list(words: list[str]) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


#: The token pattern in the syntax of DuckDB's engine, and as a SQL string.
TOKEN_PATTERN = r"""(?s)"(?:\\.|[^"\\])*(?:"|\\?\z)|==|>=|<=|!=|&&|\|\||->|<<|>>|::|##|\^=|\|=|%=|&=|\*=|/=|\+=|-=|\+\+|--|[=><!&|\-+:^#%/*(){},;\[\]]|[^\s"=><!&|\-+:^#%/*(){},;\[\]]+"""
RAW_TOKENS = f"regexp_extract_all(code, '{TOKEN_PATTERN}')"

MARKED = "(t LIKE '@@%' AND t LIKE '%@@' AND strlen(t) >= 4)"


def norm(t: str, full: bool = False) -> str:
    """Normalisation of a token expression."""
    default = "CASE " + " ".join(f"WHEN starts_with({t}, '{p}') THEN '{p}XXX'" for p in PREFIXES) + f" ELSE {t} END"
    hexa = f"lower(regexp_extract({t}, '\\A0x0*([0-9a-fA-F]*)\\z', 1))"
    fits = f"(regexp_matches({t}, '\\A0x[0-9a-fA-F]+\\z') AND (length({hexa}) < 16 OR (length({hexa}) = 16 AND {hexa} < '8')))"
    number = lambda d: f"CASE WHEN length({d}) > 2 THEN '<NUM_' || length({d}) || '>' WHEN {d} = '' THEN '0x0' ELSE '0x' || {d} END"
    dec = f"(CASE WHEN regexp_matches({t}, '\\A[+-]?[0-9]+\\z') THEN try_cast({t} AS BIGINT) END)"
    out = f"""CASE WHEN {t} LIKE '"%' AND {t} LIKE '%"' THEN '<STRING>'
      WHEN regexp_matches({t}, '\\A[a-z]*Stack_[0-9]+\\z') THEN '<ghidra_stack>'
      WHEN regexp_matches({t}, '\\A[a-z]*Var[0-9]+\\z') THEN '<ghidra_var>'
      WHEN regexp_matches({t}, '\\A(?:s_|PTR_)[a-zA-Z0-9_]+[a-fA-F0-9]{{8}}\\z') THEN left({t}, length({t}) - 8)
      WHEN regexp_matches({t}, '0x[0-9a-fA-F]+') THEN CASE WHEN {fits} THEN {number(hexa)} ELSE {default} END
      WHEN {dec} < 0 THEN '0x' || lower(printf('%x', {dec}))
      WHEN {dec} >= 256 THEN '<NUM_' || length(printf('%x', {dec})) || '>'
      WHEN {dec} IS NOT NULL THEN '0x' || printf('%x', {dec})
      ELSE {default} END"""
    if full:
        return f"(CASE WHEN ({out}) IN ({_list(KEPT_TOKENS)}) THEN ({out}) ELSE '?' END)"
    return f"({out})"


def label(var: str, lang: str, key: str) -> str:
    """The made label of a name, a language and an entry."""
    k = f"((3 * length({var}) + instr({var}, 'e')) % 8)"
    return f"""CASE WHEN starts_with({var}, 'sub_') THEN '{{"T": 9, "t": "' || CASE WHEN {k} < 4 THEN 'HAL_' ELSE 'run_' END || {lang} || '"}}'
      WHEN {k} = 0 THEN '{{"T": 6, "n": "node_' || {lang} || '", "l": [{{"T": 4, "n": "a", "t": "int", "s": ' || CASE WHEN length({var}) % 4 = 0 THEN '8' ELSE '4' END || '}}, {{"T": 5, "s": 4}}, {{"T": 4, "n": "p", "t": "char *", "s": 8}}], "s": 16}}'
      WHEN {k} = 1 THEN '{{"T": 3, "t": "const node_' || {lang} || '"}}'
      WHEN {k} = 2 THEN '{{"T": 7, "n": "u_' || {lang} || '", "l": [{{"T": 4, "n": "i", "t": "int", "s": 4}}, {{"T": 4, "n": "d", "t": "double", "s": 8}}]}}'
      WHEN {k} = 3 THEN '{{"T": 2, "n": ' || length({lang}) || ', "s": 4, "t": "int"}}'
      WHEN {k} = 4 THEN '{{"T": 1, "n": "int", "s": 4}}'
      WHEN {k} = 5 THEN '{{"T": 10}}'
      WHEN {k} = 6 THEN CASE WHEN length({var}) % 8 = 2 THEN 'ptr<' || {var} || '>' ELSE 'ptr<v' || ({key} % 3) || '>' END
      ELSE '{{"T": 3, "t": "u_' || {lang} || '_0"}}' END"""


def mark_words(words: str) -> str:
    return f"list_transform({words}, lambda t: CASE WHEN length(t) >= 10 THEN '@@' || CASE WHEN length(t) % 2 = 1 THEN 'sub_' ELSE '' END || t || '@@' ELSE t END)"


_PAD = f"list_transform(range({max(SIZES)}), lambda i: '??')"


def renamed(span: str) -> str:
    """A span with marked tokens numbered by first appearance."""
    big = "(t LIKE '@@%' AND t LIKE '%@@' AND strlen(t) > 4)"
    names = f"list_filter({span}, lambda t, i: {big} AND list_position({span}, t) = i)"
    return f"list_transform({span}, lambda t: CASE WHEN {big} THEN '@@var_' || (list_position({names}, t) - 1) || '@@' ELSE t END)"


def span_hash(span: str, disc: str) -> str:
    blobs = f"list_transform({renamed(span)}, lambda t: encode(t))"
    return f"left(sha256(list_reduce({blobs}, lambda a, b: a || '\\xFF'::BLOB || b) || encode({disc})), 24)"


#: Entries of `documents`, their targets, and flanking windows of all sizes.
ENTRIES = f"""
entries AS (SELECT doc_id AS entry_id, lang, source, {mark_words("regexp_extract_all(coalesce(text, ''), '\\S+')")} AS tokens FROM documents),
padded AS (SELECT entry_id, lang, tokens, list_concat(list_concat({_PAD}, list_transform(tokens, lambda t: {norm("t")})), {_PAD}) AS p FROM entries),
targets AS (SELECT entry_id, lang, p, i - 1 AS pos, tokens[i] AS t FROM (SELECT entry_id, lang, p, tokens, unnest(range(1, len(tokens) + 1)) AS i FROM padded) WHERE tokens[i] LIKE '@@%' AND tokens[i] LIKE '%@@' AND strlen(tokens[i]) >= 4),
named AS (SELECT entry_id, lang, p, pos, substr(t, 3, length(t) - 4) AS var, CASE WHEN starts_with(substr(t, 3), 'sub_') THEN 'function' ELSE 'variable' END AS kind FROM targets),
truth AS (SELECT entry_id, var, kind, lang, count(*) AS n_occurrences, length(var) % 7 <> 0 AS human, {label("var", "lang", "entry_id")} AS label FROM named GROUP BY entry_id, var, kind, lang)"""

_AT = f"(pos + {max(SIZES)})"
_SHORT = "CASE WHEN kind = 'function' THEN 'fn' ELSE 'var' END"
WINDOWS = f"""
sides AS (SELECT entry_id, lang, pos, var, kind, n, false AS flank, p[{_AT} - n + 1 : {_AT}] AS span, 'left_' || {_SHORT} AS disc FROM named, (SELECT unnest([{", ".join(map(str, SIZES))}]) AS n)
  UNION ALL SELECT entry_id, lang, pos, var, kind, n, true, p[{_AT} + 2 : {_AT} + 1 + n], 'right_' || {_SHORT} FROM named, (SELECT unnest([{", ".join(map(str, SIZES))}]) AS n)),
windows AS (SELECT entry_id, lang, pos, var, kind, n, flank, {span_hash("span", "disc")} AS hash FROM sides)"""

#: The exact split: the first four fifths of the entries in the order of a hash.
SPLIT = """
split AS (SELECT entry_id, row_number() OVER (ORDER BY md5(entry_id || ':42'), entry_id) <= floor(0.8 * (SELECT count(*) FROM entries)) AS train FROM entries)"""

VOCAB = """
vocab_counts AS (SELECT kind, label, sum(n_occurrences)::BIGINT AS count FROM truth {where} GROUP BY kind, label),
vocab AS (SELECT kind, (row_number() OVER (PARTITION BY kind ORDER BY count DESC, label) - 1)::INT AS id, label, count FROM vocab_counts)"""
VOCAB_ALL = VOCAB.format(where="WHERE human")
VOCAB_TRAIN = VOCAB.format(where="JOIN split USING (entry_id) WHERE human AND train")


def counts(train: bool) -> str:
    where = "JOIN split s USING (entry_id) WHERE t.human AND s.train" if train else "WHERE t.human"
    return f"""
counted AS (SELECT w.n, w.hash, w.kind, t.label, count(*) AS count FROM windows w JOIN truth t USING (entry_id, var) {where} GROUP BY ALL),
ranked AS (SELECT c.*, v.id AS vocab_id, row_number() OVER (PARTITION BY n, hash, c.kind ORDER BY c.count DESC, label) AS rank FROM counted c JOIN vocab v USING (kind, label)),
model AS (SELECT n, hash, kind, rank::INT AS rank, vocab_id, label, count, sum(count) OVER (PARTITION BY n, hash, kind)::BIGINT AS total FROM ranked WHERE rank <= 5)"""


PREDICT = """
found AS (SELECT w.entry_id, w.pos, w.flank, w.var, w.kind, w.n, m.label, m.count FROM windows w JOIN split s USING (entry_id) JOIN model m USING (n, hash) WHERE NOT s.train),
solved AS (SELECT * FROM (SELECT *, max(n) OVER (PARTITION BY entry_id, pos, flank) AS best FROM found) WHERE n = best),
shares AS (SELECT *, count / sum(count) OVER (PARTITION BY entry_id, pos, flank) AS p FROM solved),
votes AS (SELECT entry_id, var, kind, label AS name, sum(p) AS sum_p, count(*) AS hits FROM shares GROUP BY ALL),
scored AS (SELECT entry_id, var, kind, row_number() OVER (PARTITION BY entry_id, var, kind ORDER BY round(0.5 * (sum_p + hits), 9) DESC, name) AS rank, name AS pred, sum_p / hits AS score FROM votes),
marked AS (SELECT *, contains(pred, ': 6,') OR contains(pred, ': 3,') AS composite FROM scored),
seen AS (SELECT *, sum(CASE WHEN composite THEN 0 ELSE 1 END) OVER (PARTITION BY entry_id, var, kind ORDER BY rank) AS primitives FROM marked),
single AS (SELECT entry_id, var, kind, pred, score, row_number() OVER (PARTITION BY entry_id, var, kind ORDER BY rank) AS rank FROM seen WHERE kind = 'function' OR composite OR primitives = 1),
predictions AS (SELECT p.entry_id, p.var, p.kind, p.rank, p.pred, t.label, t.n_occurrences AS count, p.score FROM single p JOIN truth t USING (entry_id, var) WHERE t.human AND p.rank <= 5)"""


def chain(*parts: str) -> str:
    return "WITH " + ",".join(parts) + "\n"


BASE = (ENTRIES, WINDOWS, SPLIT)
TRAINED = (*BASE, VOCAB_TRAIN, counts(train=True))
PREDICTED = (*TRAINED, PREDICT)
KEYWORD_LIST = _list(KEYWORDS)


# ---- types -------------------------------------------------------------------------------------------------------

_TEXT_OK = "(json_type({j}, '$.{k}') IS NULL OR json_type({j}, '$.{k}') IN ('VARCHAR', 'NULL'))"
_SIZE_OK = "(json_type({j}, '$.s') IS NULL OR json_type({j}, '$.s') IN ('UBIGINT', 'NULL'))"
_CODE_OK = "(coalesce(json_type({j}, '$.T') = 'UBIGINT', false) AND ({j} ->> '$.T')::BIGINT <= 255)"


def _member_ok(m: str) -> str:
    return " AND ".join([_CODE_OK.format(j=m), _TEXT_OK.format(j=m, k="n"), _TEXT_OK.format(j=m, k="t"), _SIZE_OK.format(j=m)])


def candidates(name: str) -> str:
    """The list of names for a pointed-to type."""
    b0 = f"regexp_replace({name}, '\\A\\s+|\\s+\\z', '', 'g')"
    b1 = f"regexp_replace({b0}, '\\A\\*+\\s*', '')"
    b2 = f"regexp_replace({b1}, '\\A(?:(?:const|mut|volatile) \\s*)+', '')"
    return f"[{b0}, {b1}, {b2}, regexp_replace({b2}, '_[0-9]+\\z', '')]"


def types(labels: str, vocab: str) -> str:
    """Parts `type_table(label, code, head_t, ok, n, s, t, l, an, asz, defs, cat)`, from labels and from `vocab(id, label)`."""
    return f"""
all_labels AS (SELECT DISTINCT label FROM ({labels}) UNION SELECT DISTINCT label FROM ({vocab})),
js AS (SELECT label, CASE WHEN json_valid(label) THEN label::JSON END AS j FROM all_labels),
heads AS (SELECT label, j, {_CODE_OK.format(j="j")} AND {_TEXT_OK.format(j="j", k="t")} AS head_ok,
  {_CODE_OK.format(j="j")} AND {_TEXT_OK.format(j="j", k="t")} AND {_TEXT_OK.format(j="j", k="n")} AND {_SIZE_OK.format(j="j")}
    AND (json_type(j, '$.l') IS NULL OR json_type(j, '$.l') = 'NULL' OR (json_type(j, '$.l') = 'ARRAY' AND len(list_filter((j -> '$.l')::JSON[], lambda m: NOT ({_member_ok("m")}))) = 0)) AS ok FROM js),
fields AS (SELECT label, CASE WHEN head_ok THEN (j ->> '$.T')::INT END AS code, CASE WHEN head_ok THEN j ->> '$.t' END AS head_t, coalesce(ok, false) AS ok, CASE WHEN ok THEN j ->> '$.n' END AS n, CASE WHEN ok THEN (j ->> '$.s')::BIGINT END AS s, CASE WHEN ok THEN j ->> '$.t' END AS t,
  CASE WHEN ok AND json_type(j, '$.l') = 'ARRAY' THEN list_transform((j -> '$.l')::JSON[], lambda m: {{'code': (m ->> '$.T')::INT, 'n': m ->> '$.n', 't': m ->> '$.t', 's': (m ->> '$.s')::BIGINT}}) END AS l,
  CASE WHEN {_CODE_OK.format(j="j")} AND json_type(j, '$.n') = 'UBIGINT' AND json_type(j, '$.s') = 'UBIGINT' THEN (j ->> '$.n')::BIGINT END AS an, CASE WHEN {_CODE_OK.format(j="j")} AND json_type(j, '$.n') = 'UBIGINT' AND json_type(j, '$.s') = 'UBIGINT' THEN (j ->> '$.s')::BIGINT END AS asz FROM heads),
typed AS (SELECT *, {{'code': code, 'n': n, 'l': l, 's': s, 't': t}} AS d FROM fields),
definitions AS (SELECT n AS name, list(d ORDER BY id) AS defs FROM (SELECT v.id, f.n, f.d FROM ({vocab}) v JOIN typed f USING (label) WHERE f.ok AND f.code IN (6, 7) AND f.n IS NOT NULL) GROUP BY n),
tried AS (SELECT label, unnest({candidates("t")}) AS name, unnest(range(4)) AS nth FROM typed WHERE ok AND code = 3 AND t IS NOT NULL),
pointed AS (SELECT label, arg_min(defs, nth) AS defs FROM tried JOIN definitions USING (name) GROUP BY label),
resolved AS (SELECT f.*, CASE WHEN f.ok AND f.code IN (6, 7) THEN [f.d] ELSE coalesce(p.defs, []) END AS defs FROM typed f LEFT JOIN pointed p USING (label)),
sorted_defs AS (SELECT *, list_filter(defs, lambda df: df.code = 6) AS structs, list_filter(defs, lambda df: df.code = 7) AS unions FROM resolved),
type_table AS (SELECT *, CASE WHEN code = 6 THEN 'struct' WHEN code = 7 THEN 'union' WHEN code = 2 THEN 'array' WHEN code = 3 AND len(structs) > 0 THEN 'ptr-struct' WHEN code = 3 AND len(unions) > 0 THEN 'ptr-union' END AS cat FROM sorted_defs)"""


def sizes(d: str, code: int) -> str:
    """Member sizes of a definition, null where one has none."""
    m = f"list_transform(list_filter({d}.l, lambda sm: sm.code <> 5), lambda sn: sn.s)"
    out = f"list_sort({m})" if code == 7 else m
    return f"CASE WHEN {d}.code = {code} AND {d}.l IS NOT NULL AND len(list_filter({m}, lambda sv: sv IS NULL)) = 0 THEN {out} END"


def offset_widths(d: str) -> str:
    at = f"list_transform({d}.l, lambda am, ai: {{'o': coalesce(list_sum(list_transform({d}.l[1 : ai - 1], lambda ax: coalesce(ax.s, 0))), 0)::BIGINT, 'w': coalesce(am.s, 0), 'p': am.code = 5}})"
    return f"list_transform(list_filter({at}, lambda aw: NOT aw.p AND aw.w > 0), lambda av: av.o || ':' || av.w)"


def any_pair(a: str, b: str, test: str) -> str:
    """Whether some x of `a` and y of `b` pass `test`."""
    return f"(len(list_filter({a}, lambda x: len(list_filter({b}, lambda y: coalesce({test}, false))) > 0)) > 0)"


def same_sizes(a: str, b: str, code: int) -> str:
    return any_pair(a, b, f"({sizes('x', code)}) = ({sizes('y', code)})")


#: Prediction and label sides `p` and `q` of a join of `type_table` with itself.
LAYOUT = f"""CASE WHEN p.code = 6 AND p.ok AND ({sizes('p.d', 6)}) IS NOT NULL AND len(q.structs) > 0 THEN 'struct' WHEN p.code = 7 AND p.ok AND ({sizes('p.d', 7)}) IS NOT NULL AND len(q.unions) > 0 THEN 'union'
  WHEN p.code = 3 AND len(p.structs) > 0 THEN CASE WHEN len(q.structs) > 0 THEN 'ptr-struct' END WHEN p.code = 3 AND len(p.unions) > 0 THEN CASE WHEN len(q.unions) > 0 THEN 'ptr-union' END
  WHEN p.code = 2 AND p.an IS NOT NULL AND q.code = 2 AND q.an IS NOT NULL THEN 'array' END"""
MATCH = f"""CASE WHEN layout_cat IN ('struct', 'ptr-struct') THEN {same_sizes('ps', 'qs', 6)} WHEN layout_cat IN ('union', 'ptr-union') THEN {same_sizes('pu', 'qu', 7)} WHEN layout_cat = 'array' THEN pn = qn AND pn * pz = qn * qz END"""

_SIGNATURE = "CASE WHEN {d}.code = 6 AND {d}.l IS NOT NULL THEN {{'s': {d}.s, 'l': list_transform({d}.l, lambda gm: {{'code': gm.code, 't': gm.t, 's': gm.s}})}} END"


def named_offsets(d: str) -> str:
    """Offsets of the named members, the last of a name, none where a type is opaque."""
    at = f"list_transform({d}.l, lambda nm, ni: {{'n': nm.n, 'o': coalesce(list_sum(list_transform({d}.l[1 : ni - 1], lambda nx: coalesce(nx.s, 0))), 0)::BIGINT, 'k': nm.s IS NOT NULL AND nm.n IS NOT NULL AND nm.code <> 5}})"
    kept = f"list_filter({at}, lambda nk: nk.k)"
    opaque = f"len(list_filter({d}.l, lambda no: no.s IS NOT NULL AND no.n IS NOT NULL AND coalesce(starts_with(no.t, '$'), false))) > 0"
    last = f"list_filter({kept}, lambda nl, nj: len(list_filter(({kept})[nj + 1 :], lambda nz: nz.n = nl.n)) = 0)"
    return f"CASE WHEN {opaque} THEN [] ELSE list_transform({last}, lambda nr: nr.o) END"


def similar(a: str, b: str) -> str:
    from .queries import _sql_name

    x, y = _sql_name(a), _sql_name(b)
    return f"({a} = {b} OR {x} = {y} OR ((starts_with({x}, {y}) OR starts_with({y}, {x})) AND abs(strlen({x}) - strlen({y})) <= 3))"


def fuzzy(a: str, b: str) -> str:
    """Whether some pair of definitions is fuzzily equal."""
    ox, oy = named_offsets("x"), named_offsets("y")
    total = f"least(len({ox}), len({oy}))"
    hits = f"len(list_filter({ox}, lambda fo: list_contains({oy}, fo)))"
    fields = f"CASE WHEN x.l IS NULL OR y.l IS NULL THEN true WHEN abs(len(x.l) - len(y.l)) > 2 THEN false WHEN {total} > 0 THEN {hits} / {total} >= 0.8 ELSE true END"
    equal = f"coalesce(({_SIGNATURE.format(d='x')}) = ({_SIGNATURE.format(d='y')}), false)"
    return any_pair(a, b, f"x.code = 6 AND y.code = 6 AND ({equal} OR (coalesce({similar('x.n', 'y.n')}, false) AND {fields}))")
