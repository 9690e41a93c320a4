"""The registered queries in DuckDB SQL, over the same tables."""

from __future__ import annotations

from kinforge.functions import rules
from kinforge.sources.records import DRESSED_ADDRESSES, DRESSED_NAMES


def _list(words) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


_WORDS = r"""
tk AS (SELECT *, regexp_extract_all(lower(text), '[\p{L}\p{M}\p{N}]+') AS tw, 1 + CAST(substr(source, 4) AS INTEGER) % 3 AS src FROM documents),
"""
RECORDS = (
    _WORDS
    + """
R AS (SELECT 'S' || src || '-' || doc_id AS entity_id, array_to_string(tw[1:4], ' ') AS business_name,
        array_to_string(tw[5:14], ' ') AS business_address, lang AS country, src, doc_id, text FROM tk),
T AS (SELECT a.entity_id AS s1, b.entity_id AS cand FROM R a JOIN R b ON a.country = b.country AND a.text = b.text WHERE a.src = 1 AND b.src > 1),
G AS (SELECT r.entity_id AS s1, r.country, count(T.cand) AS n FROM R r LEFT JOIN T ON T.s1 = r.entity_id WHERE r.src = 1 GROUP BY ALL),
"""
)


def _filled(patterns: tuple[str, ...], turn: str) -> str:
    text = f"{_list(patterns)}[({turn}) % {len(patterns)} + 1]"
    for k in range(1, 9):
        text = f"replace({text}, '{{{k}}}', coalesce({f'tw[1:4][{k}]' if k < 5 else f'tw[5:14][{k - 4}]'}, ''))"
    for mark, value in (("a", "1 + n_chars % 997"), ("b", "1 + doc_id % 89"), ("z", "10000 + doc_id * 7919 % 89999")):
        text = f"replace({text}, '{{{mark}}}', CAST({value} AS VARCHAR))"
    return text


DRESSED = f"""{_WORDS}
R AS (SELECT 'S' || src || '-' || doc_id AS entity_id, {_filled(DRESSED_NAMES, "doc_id")} AS business_name,
        {_filled(DRESSED_ADDRESSES, "doc_id // 3")} AS business_address, lang AS country, src, doc_id, text FROM tk),
"""


def folded(x: str) -> str:
    """Case folding of the letters that the tables have."""
    return f"replace(lower({x}), 'ß', 'ss')"


BUCKET = "CASE WHEN n = 0 THEN 'singleton' WHEN n = 1 THEN '1_match' WHEN n <= 5 THEN '2-5_matches' ELSE '6+_matches' END"


def _soundex(word: str) -> str:
    upper = f"upper({word})"
    letters = "".join(rules.SOUNDEX)
    codes = "".join(c * len(x) for x, c in rules.SOUNDEX.items())
    text = f"translate(regexp_replace({upper}, '[^{letters}]', '0', 'g'), '{letters}', '{codes}')"
    for c in "0123456":
        text = f"regexp_replace({text}, '{c}+', '{c}', 'g')"
    return f"CASE WHEN regexp_matches({upper}, '^[A-Z]') THEN rpad(substr({upper}, 1, 1) || substr(replace(substr({text}, 2), '0', ''), 1, 3), 4, '0') ELSE '' END"


KEYS = rf"""
KV AS (SELECT *, regexp_replace({folded("business_name")}, '\.(?:{"|".join(rules.DOMAINS)})([^\p{{L}}\p{{M}}\p{{N}}_]|$)', ' \1', 'g') AS kn,
    CASE WHEN lower(trim(business_address)) IN ({", ".join(f"'{x}'" for x in rules.MISSING_ADDRESS_KEYS)}) THEN '' ELSE trim(business_address) END AS ka FROM R),
W AS (SELECT *,
    list_filter(regexp_extract_all(kn, '[\p{{L}}\p{{M}}\p{{N}}]+'), lambda x: length(x) >= 2 AND NOT list_contains({_list(rules.SUFFIX_TOKENS)}, x)) AS t,
    list_filter(regexp_extract_all(ka, '[\p{{L}}\p{{M}}\p{{N}}_]+'), lambda x: regexp_full_match(x, '\p{{Nd}}+')) AS d,
    list_filter(regexp_extract_all({folded("ka")}, '[\p{{L}}\p{{M}}]+'), lambda x: length(x) >= 3 AND NOT list_contains({_list(rules.ADDRESS_STOPWORDS)}, x)) AS w
  FROM KV),
X AS (SELECT *, {_soundex("t[1]")} AS sx, d[1] AS street, CASE WHEN len(d) > 0 AND length(d[len(d)]) >= 3 THEN d[len(d)] END AS postal FROM W),
L AS (SELECT entity_id, country, src, doc_id,
    list_concat(list_filter(t, lambda x: length(x) >= 3), CASE WHEN len(t) >= 2 THEN [t[1] || '_' || t[2]] ELSE [] END) AS k1,
    list_concat(CASE WHEN length(array_to_string(t, '')) >= 4 THEN ['p4_' || substr(array_to_string(t, ''), 1, 4)] ELSE [] END,
                CASE WHEN len(t) >= 2 THEN ['init2_' || substr(t[1], 1, 2) || substr(t[2], 1, 2)] ELSE [] END) AS k2,
    list_concat(CASE WHEN sx <> '' THEN ['sx_' || sx] ELSE [] END, CASE WHEN sx <> '' AND len(t) >= 2 THEN ['sx2_' || sx || '_' || substr(t[2], 1, 2)] ELSE [] END) AS k3,
    list_concat(
      CASE WHEN postal IS NOT NULL THEN ['pin_' || postal] ELSE [] END,
      CASE WHEN postal IS NOT NULL AND len(t) > 0 THEN ['post_name_' || postal || '_' || substr(t[1], 1, 2)] ELSE [] END,
      CASE WHEN postal IS NOT NULL AND street IS NOT NULL THEN ['post_num_' || postal || '_' || street] ELSE [] END,
      CASE WHEN street IS NOT NULL AND len(w) > 0 THEN ['st_num_word_' || street || '_' || substr(w[1], 1, 5)] ELSE [] END,
      CASE WHEN street IS NOT NULL AND len(w) > 1 THEN ['st_num_word2_' || street || '_' || substr(w[2], 1, 5)] ELSE [] END,
      list_transform(range(1, len(w)), lambda i: 'ash_' || w[i] || '_' || w[i + 1]),
      list_transform(list_filter(w, lambda x: length(x) >= 5), lambda x: 'aw_' || x)) AS k4
  FROM X),
K AS (SELECT entity_id, country, src, doc_id, k.strategy, k.key, pos FROM (
    SELECT entity_id, country, src, doc_id, unnest(ks) AS k, unnest(range(len(ks))) AS pos FROM (
      SELECT *, list_concat(
        list_transform(k1, lambda x: {{'strategy': 'name_tokens', 'key': x}}), list_transform(k2, lambda x: {{'strategy': 'char_ngrams', 'key': x}}),
        list_transform(k3, lambda x: {{'strategy': 'phonetic', 'key': x}}), list_transform(k4, lambda x: {{'strategy': 'address', 'key': x}})) AS ks FROM L))),
D AS (SELECT country, strategy, key, count(*) AS df FROM K WHERE src > 1 GROUP BY ALL),
N AS (SELECT country, count(*) AS n FROM R WHERE src > 1 GROUP BY ALL),
I AS (SELECT D.*, ln(1.0 + n / (1.0 + df)) AS idf FROM D JOIN N USING (country)),
"""

CAPS = "CASE strategy " + " ".join(f"WHEN '{s}' THEN {n}" for s, n in rules.POSTING_CAPS.items()) + " END"
WEIGHT = f"""CASE strategy
    WHEN 'name_tokens' THEN idf + CASE WHEN contains(key, '_') THEN {rules.IDF_BONUS['bigram']} ELSE 0 END
    WHEN 'char_ngrams' THEN {rules.FIXED_WEIGHT['char_ngrams']} WHEN 'phonetic' THEN {rules.FIXED_WEIGHT['phonetic']}
    ELSE idf + CASE WHEN starts_with(key, 'post_name_') OR starts_with(key, 'post_num_') THEN {rules.IDF_BONUS['post_num_']}
                    WHEN starts_with(key, 'ash_') OR starts_with(key, 'st_num_word') THEN {rules.IDF_BONUS['ash_']} ELSE 0 END END"""


def pairs(k: int, strategies=rules.STRATEGIES, caps: dict[str, int] | None = None) -> str:
    allowed = "CASE strategy " + " ".join(f"WHEN '{s}' THEN {n}" for s, n in (rules.POSTING_CAPS | (caps or {})).items()) + " END"
    chosen = ", ".join(f"'{s}'" for s in strategies)
    return f"""
H AS (SELECT country, strategy, key, {WEIGHT} AS weight FROM I WHERE df <= {allowed} AND strategy IN ({chosen})),
S AS (SELECT q.entity_id AS s1, c.entity_id AS cand, round(sum(weight), 9) AS score, min(q.pos) AS fp, min(c.src) AS csrc
      FROM K q JOIN H USING (country, strategy, key) JOIN K c USING (country, strategy, key) WHERE q.src = 1 AND c.src > 1 GROUP BY ALL),
P AS (SELECT s1, cand, score, csrc, rnk FROM (SELECT *, row_number() OVER (PARTITION BY s1 ORDER BY score DESC, fp, csrc, cand) AS rnk FROM S) WHERE rnk <= {k}),
"""


def sql(body: str, *ctes: str) -> str:
    return "WITH " + "".join(ctes).strip().rstrip(",") + "\n" + body


def words_map(table) -> dict[str, str]:
    """What a single word becomes under an ordered table of whole-word rules."""
    plain = [(p, r) for patterns, r in table for p in patterns if p.isalpha()]
    out = {}
    for word, _ in plain:
        text = word
        for pattern, replacement in plain:
            text = " ".join(replacement if w == pattern else w for w in text.split(" "))
        out[word] = text
    return out


def mapped(column: str, table) -> str:
    """Whole words replaced; what is between words stays."""
    cases = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in words_map(table).items())
    return f"array_to_string(list_transform(regexp_extract_all({column}, '[\\p{{L}}\\p{{N}}_]+|[^\\p{{L}}\\p{{N}}_]+'), lambda x: CASE x {cases} ELSE x END), '')"


def _possessive(x: str) -> str:
    return rf"regexp_replace(regexp_replace({x}, '[''’]s([^\p{{L}}\p{{N}}_]|$)', '\1', 'g'), '[''’]', '', 'g')"


def _acronyms(x: str) -> str:
    for letters in ("lp", "llc", "llp"):
        dotted = r"\s*\.\s*".join(letters)
        x = rf"regexp_replace({x}, '(^|[^\p{{L}}\p{{N}}_]){dotted}\s*\.([\p{{L}}\p{{N}}_])', '\1 {letters} \2', 'g')"
        x = rf"regexp_replace({x}, '(^|[^\p{{L}}\p{{N}}_]){dotted}([^\p{{L}}\p{{N}}_]|$)', '\1 {letters} \2', 'g')"
    return x


def _collapsed(x: str) -> str:
    return rf"trim(regexp_replace({x}, '[^\p{{L}}\p{{M}}\p{{N}}]+', ' ', 'g'))"


def _relations(x: str) -> str:
    """Two letters with a dot between them in addresses (a slash is a space already)."""
    for letters, phrase in (("bh", "behind"), ("co", "care of"), ("wo", "wife of"), ("so", "son of"), ("do", "daughter of")):
        x = rf"regexp_replace({x}, '(^|[^\p{{L}}\p{{N}}_]){letters[0]}\.{letters[1]}([^\p{{L}}\p{{N}}_]|$)', '\1{phrase}\2', 'g')"
    return x


def _without_forms(x: str) -> str:
    """Words apart by two spaces, so that neighbouring phrases share none."""
    text = f"' ' || replace({x}, ' ', '  ') || ' '"
    for phrase in rules.SUFFIX_PHRASES:
        text = f"regexp_replace(replace({text}, ' {phrase.replace(' ', '  ')} ', '   '), ' +', '  ', 'g')"
    kept = f"array_to_string(list_filter(string_split({text}, ' '), lambda x: x <> '' AND NOT list_contains({_list(rules.SUFFIX_TOKENS)}, x)), ' ')"
    return f"regexp_replace(regexp_replace({kept}, '^(?:(?:and|&)(?: |$))+', ''), '(?:(?:^| )(?:and|&))+$', '')"


_MISSING = ", ".join(f"'{x}'" for x in rules.MISSING)
_ADDRESS_RULES = (*rules.ADDRESS_ABBREVIATIONS, (("hno",), "house number"))
_SYMBOLS = f"replace(replace(replace({folded('n_raw')}, '&', ' and '), '@', ' at '), '+', ' and ')"
_PLACES = _possessive(f"replace({folded('a_raw')}, '&', ' and ')")
NORM = rf"""
M0 AS (SELECT *, CASE WHEN lower(trim(business_name)) IN ({_MISSING}) THEN '' ELSE trim(business_name) END AS n_raw,
    CASE WHEN lower(trim(business_address)) IN ({_MISSING}) THEN '' ELSE trim(business_address) END AS a_raw FROM R),
M1 AS (SELECT *, {_acronyms(_possessive(_SYMBOLS))} AS n0, {_relations(rf"regexp_replace({_PLACES}, '[/\\,]', ' ', 'g')")} AS a0 FROM M0),
M2 AS (SELECT *, {_collapsed("n0")} AS n1_, {_collapsed(mapped("a0", _ADDRESS_RULES))} AS a_norm FROM M1),
M3 AS (SELECT *, {mapped("n1_", (*rules.LEGAL_SUFFIXES, *rules.GENERIC_ABBREVIATIONS))} AS n_norm,
    CASE WHEN a_norm = '' THEN [] ELSE string_split(a_norm, ' ') END AS at_ FROM M2),
M4 AS (SELECT *, {_without_forms("n_norm")} AS nc, list_filter(list_transform(at_, lambda x, i: {{'i': i - 1, 't': x}}), lambda x: regexp_full_match(x.t, '\p{{Nd}}+')) AS dg, len(at_) AS n_at FROM M3),
M AS (SELECT *, CASE WHEN nc = '' THEN n_norm ELSE nc END AS n_clean, CASE WHEN n_norm = '' THEN [] ELSE string_split(n_norm, ' ') END AS nt_,
    CASE WHEN len(dg) = 1 AND dg[1].i <= 1 THEN CASE WHEN length(dg[1].t) >= 4 AND dg[1].i >= n_at - 2 THEN dg[1].t END
         WHEN len(dg) = 1 THEN CASE WHEN dg[1].i >= n_at / 2 AND length(dg[1].t) >= 3 THEN dg[1].t END
         WHEN len(dg) > 1 AND (length(dg[len(dg)].t) >= 3 OR dg[len(dg)].i >= n_at - 2) THEN dg[len(dg)].t END AS a_postal,
    CASE WHEN len(dg) = 1 AND dg[1].i <= 1 THEN dg[1].t
         WHEN len(dg) = 1 THEN CASE WHEN dg[1].i < n_at / 2 OR length(dg[1].t) < 3 THEN dg[1].t END
         WHEN len(dg) > 1 AND dg[1].i <= 2 THEN dg[1].t END AS a_street FROM M4),
"""
NORMALIZED = "SELECT entity_id, n_norm, n_clean, n_norm <> '' AS n_has, a_norm, a_norm <> '' AS a_has, a_postal, a_street, country AS c_norm FROM M"

SIDES = """
J AS (SELECT P.*, a.n_norm AS n1, b.n_norm AS n2, a.a_norm AS a1, b.a_norm AS a2, a.n_raw AS r1, b.n_raw AS r2, a.n_clean AS c1, b.n_clean AS c2, a.nt_ AS t1, b.nt_ AS t2, a.at_ AS u1, b.at_ AS u2,
        a.a_raw AS ra1, b.a_raw AS ra2, coalesce(a.a_postal, '') AS p1, coalesce(b.a_postal, '') AS p2, a.a_street AS s1_, b.a_street AS s2_, a.country AS k1, b.country AS k2,
        a.n_norm <> '' AND b.n_norm <> '' AS named, a.a_norm <> '' AND b.a_norm <> '' AS placed
      FROM P JOIN M a ON a.entity_id = P.s1 JOIN M b ON b.entity_id = P.cand),
"""


def jaccard(a: str, b: str) -> str:
    both = f"len(list_intersect(list_distinct({a}), list_distinct({b})))"
    return f"({both} * 1.0 / nullif(len(list_distinct(list_concat({a}, {b}))), 0))"


def qgrams(text: str) -> str:
    return f"(CASE WHEN length({text}) < 3 THEN [{text}] ELSE list_distinct(list_transform(range(1, length({text}) - 1), lambda i: substr({text}, i, 3))) END)"


#: DuckDB measures edits in bytes: one spare ASCII sign stands for each letter beyond ASCII.
_BEYOND = "àáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿœ"
_SPARE = "ABCDEFGHIJKLMNOPQRSTUVWXYZ!#$%&*"


def one_byte(x: str) -> str:
    return f"translate({x}, '{_BEYOND}', '{_SPARE}')"


def lcs(a: str, b: str) -> str:
    """Longest common subsequence of texts of up to 126 letters, the first as bits of a wide integer."""
    full = f"((CAST(1 AS HUGEINT) << length({a})) - 1)"
    places = f"list_transform(string_split({b}, ''), lambda c: list_sum(list_transform(range(1, length({a}) + 1), lambda i: CASE WHEN substr({a}, i, 1) = c THEN CAST(1 AS HUGEINT) << (i - 1) ELSE CAST(0 AS HUGEINT) END)))"
    left = f"list_reduce(list_prepend({full}, {places}), lambda s, m: ((s + (s & m)) | (s - (s & m))) & {full})"
    return f"CASE WHEN {a} = '' OR {b} = '' THEN 0 ELSE length({a}) - bit_count({left}) END"


def _joined(tokens: str) -> str:
    return f"array_to_string(list_sort({tokens}), ' ')"


def _lev(a: str, b: str) -> str:
    return f"CASE WHEN {a} = '' AND {b} = '' THEN 1.0 ELSE 1 - levenshtein({one_byte(a)}, {one_byte(b)}) * 1.0 / greatest(length({a}), length({b})) END"


_SET_RATIO = """CASE WHEN x{s} = '' OR y{s} = '' THEN CASE WHEN h{s} > 0 THEN 1.0 ELSE 0.0 END
    WHEN h{s} = 0 THEN 1 - (length(x{s}) + length(y{s}) - 2 * m{s}) * 1.0 / (length(x{s}) + length(y{s}))
    ELSE greatest(1 - (length(x{s}) + length(y{s}) - 2 * m{s}) * 1.0 / (2 * h{s} + 2 + length(x{s}) + length(y{s})),
                  1 - (1 + length(x{s})) * 1.0 / (2 * h{s} + 1 + length(x{s})), 1 - (1 + length(y{s})) * 1.0 / (2 * h{s} + 1 + length(y{s}))) END"""
_DIGITS = r"list_distinct(list_transform(regexp_extract_all({x}, '\p{{Nd}}+'), lambda x: coalesce(nullif(ltrim(x, '0'), ''), '0')))"


def _side(s: str, a: str, b: str, on: str) -> str:
    """Sorted tokens (f, g), own tokens (x, y), length of the shared ones (h) and both subsequences (l, m) of one side."""
    return f"""
L{s}0 AS (SELECT *, {_joined(a)} AS f{s}, {_joined(b)} AS g{s}, {_joined(f"list_filter(list_distinct({a}), lambda q: NOT list_contains({b}, q))")} AS x{s},
    {_joined(f"list_filter(list_distinct({b}), lambda q: NOT list_contains({a}, q))")} AS y{s}, length({_joined(f"list_intersect(list_distinct({a}), list_distinct({b}))")}) AS h{s} FROM {on}),
L{s} AS (SELECT *, {lcs(f"f{s}", f"g{s}")} AS l{s}, {lcs(f"x{s}", f"y{s}")} AS m{s} FROM L{s}0),
"""


RATIOS = _side("n", "t1", "t2", "J") + _side("a", "u1", "u2", "Ln")


def _sorted_ratio(s: str) -> str:
    return f"CASE WHEN f{s} = '' AND g{s} = '' THEN 1.0 ELSE 2 * l{s} * 1.0 / (length(f{s}) + length(g{s})) END"


def narrow(x: str, digits: int = 5) -> str:
    """A value that the features keep as a 32-bit float."""
    return f"round(CAST(CAST({x} AS REAL) AS DOUBLE), {digits})"


def _long(x: str) -> str:
    return f"CAST({x} AS BIGINT)"


def _where(known: str, x: str) -> str:
    return f"CASE WHEN {known} THEN {x} ELSE -1 END"


def _yes(condition: str) -> str:
    return f"CASE WHEN {condition} THEN 1 ELSE 0 END"


def _common(a: str, b: str) -> str:
    return f"len(list_intersect(list_distinct({a}), list_distinct({b})))"


_STREET = "regexp_replace({x}, '^0+(.)', '\\1')"
_S1, _S2 = _STREET.format(x="s1_"), _STREET.format(x="s2_")
_D1, _D2 = _DIGITS.format(x="ra1"), _DIGITS.format(x="ra2")
_RATE = "CASE lower(k1) " + " ".join(f"WHEN '{c}' THEN {r}" for c, r in rules.COUNTRY_RATES.items()) + f" ELSE {rules.OTHER_COUNTRY_RATE} END"
_CODED = "p1 <> '' AND p2 <> ''"
#: SQL of every feature over La (pairs with their sides).
FEATURE_SQL = {
    "name_lev_sim": narrow(_where("named", _lev("n1", "n2"))),
    "name_jw_sim": narrow(_where("named", f"jaro_winkler_similarity({one_byte('n1')}, {one_byte('n2')})")),
    "name_token_sort": narrow(_where("named", _sorted_ratio("n"))),
    "name_token_set": narrow(_where("named", _SET_RATIO.format(s="n"))),
    "name_word_jaccard": narrow(_where("named", f"coalesce({jaccard('t1', 't2')}, 0)")),
    "name_char3_jaccard": narrow(_where("named", jaccard(qgrams("c1"), qgrams("c2")))),
    "name_common_tokens": _long(_where("named", _common("t1", "t2"))),
    "name_len_diff": _long(_where("named", "abs(length(n1) - length(n2))")),
    "name_len_ratio": narrow(_where("named", "least(length(n1), length(n2)) * 1.0 / greatest(length(n1), length(n2))")),
    "name_exact_clean": _long(_where("named", _yes("c1 = c2"))),
    "name_exact_raw": _long(_where("named", _yes("lower(r1) = lower(r2)"))),
    "name_suffix_match": narrow(_where("named", "0.5")),
    "addr_lev_sim": narrow(_where("placed", _lev("a1", "a2"))),
    "addr_jw_sim": narrow(_where("placed", f"jaro_winkler_similarity({one_byte('a1')}, {one_byte('a2')})")),
    "addr_token_sort": narrow(_where("placed", _sorted_ratio("a"))),
    "addr_token_set": narrow(_where("placed", _SET_RATIO.format(s="a"))),
    "addr_word_jaccard": narrow(_where("placed", f"coalesce({jaccard('u1', 'u2')}, 0)")),
    "addr_common_tokens": _long(_where("placed", _common("u1", "u2"))),
    "addr_len_diff": _long(_where("placed", "abs(length(a1) - length(a2))")),
    "addr_exact_norm": _long(_where("placed", _yes("a1 = a2"))),
    "postal_exact": _long(_where(_CODED, _yes("p1 = p2"))),
    "postal_sim": narrow(_where(_CODED, _lev("p1", "p2"))),
    "street_num_exact": _long(_where("s1_ IS NOT NULL AND s2_ IS NOT NULL", _yes(f"{_S1} = {_S2}"))),
    "digits_overlap": _long(_where("placed", _yes(f"len(list_intersect({_D1}, {_D2})) > 0"))),
    "digits_jaccard": narrow(_where("placed", f"coalesce({jaccard(_D1, _D2)}, 0)")),
    "has_name_s1": _long(_yes("n1 <> ''")),
    "has_name_cand": _long(_yes("n2 <> ''")),
    "both_have_name": _long(_yes("named")),
    "has_addr_s1": _long(_yes("a1 <> ''")),
    "has_addr_cand": _long(_yes("a2 <> ''")),
    "both_have_address": _long(_yes("placed")),
    "has_postal_s1": _long(_yes("p1 <> ''")),
    "has_postal_cand": _long(_yes("p2 <> ''")),
    "both_have_postal": _long(_yes(_CODED)),
    "same_country": _long(_yes("k1 <> '' AND lower(k1) = lower(k2)")),
    "country_freq": narrow(_RATE),
    "blocking_score": narrow("score", 4),
    "candidate_rank": _long("rnk"),
    "candidate_count": _long("count(*) OVER (PARTITION BY s1)"),
    "score_gap_to_top": narrow("max(score) OVER (PARTITION BY s1) - score", 4),
    "is_source2": _long(_yes("csrc = 2")),
    "is_source3": _long(_yes("csrc = 3")),
}
ALL_FEATURES = ", ".join(f"{x} AS {name}" for name, x in FEATURE_SQL.items())
LABEL = "CAST(CASE WHEN EXISTS (SELECT 1 FROM T WHERE T.s1 = La.s1 AND T.cand = La.cand) THEN 1 ELSE 0 END AS BIGINT) AS label"


def chosen(*names: str) -> str:
    return ", ".join(f"{FEATURE_SQL[name]} AS {name}" for name in names)


SCORE = "least(1.0, round(score / 40.0, 6))"
F05 = "CASE WHEN n_true = 0 AND n_pred = 0 THEN 1.0 WHEN tp = 0 THEN 0.0 ELSE 1.25 * (tp * 1.0 / n_pred) * (tp * 1.0 / n_true) / (0.25 * tp / n_pred + tp * 1.0 / n_true) END"
PREC = "CASE WHEN n_true = 0 AND n_pred = 0 THEN 1.0 WHEN n_true = 0 OR n_pred = 0 THEN 0.0 ELSE tp * 1.0 / n_pred END"
REC = "CASE WHEN n_true = 0 AND n_pred = 0 THEN 1.0 WHEN n_true = 0 OR n_pred = 0 THEN 0.0 ELSE tp * 1.0 / n_true END"
MACRO = f"""round(avg({PREC}), 6) AS macro_precision, round(avg({REC}), 6) AS macro_recall, round(avg({F05}), 6) AS macro_f05,
  round(coalesce(avg(CASE WHEN n_true = 0 THEN {F05} END), 1.0), 6) AS singleton_accuracy,
  round(coalesce(avg(CASE WHEN n_true > 0 THEN {F05} END), 0.0), 6) AS non_singleton_f05, count(*) AS n_entities,
  CAST(sum(CASE WHEN n_true = 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_singletons, CAST(sum(CASE WHEN n_true > 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_non_singletons"""
COUNTS = f"""
Q AS (SELECT r.entity_id AS s1, (SELECT count(*) FROM T WHERE T.s1 = r.entity_id) AS n_true,
        (SELECT count(*) FROM P WHERE P.s1 = r.entity_id AND {SCORE} >= 0.75) AS n_pred,
        (SELECT count(*) FROM P JOIN T ON T.s1 = P.s1 AND T.cand = P.cand WHERE P.s1 = r.entity_id AND {SCORE} >= 0.75) AS tp
      FROM R r WHERE r.src = 1),
"""
RANK_K = 75
BLOCK = (RECORDS, KEYS, pairs(RANK_K))
SIDED = (*BLOCK, NORM, SIDES, RATIOS)
#: Caps that bind on small tables too.
LOW_CAPS = {"name_tokens": 8, "char_ngrams": 20, "phonetic": 25, "address": 6}
MISSING_FLAGS = (
    "has_name_s1", "has_name_cand", "both_have_name", "has_addr_s1", "has_addr_cand", "both_have_address", "has_postal_s1", "has_postal_cand", "both_have_postal",
    "same_country", "country_freq", "name_suffix_match",
)
def sweep(first: str, step: str, n: int) -> str:
    return f"""
TH AS (SELECT round({first} + {step} * i, 6) AS threshold FROM range(0, {n}) r(i)),
C AS (SELECT r.entity_id AS s1, threshold, (SELECT count(*) FROM T WHERE T.s1 = r.entity_id) AS n_true,
    count(P.cand) FILTER (WHERE {SCORE} >= threshold) AS n_pred, count(T2.cand) FILTER (WHERE {SCORE} >= threshold) AS tp
  FROM R r CROSS JOIN TH LEFT JOIN P ON P.s1 = r.entity_id LEFT JOIN T T2 ON T2.s1 = P.s1 AND T2.cand = P.cand WHERE r.src = 1 GROUP BY ALL),
V AS (SELECT threshold, {MACRO} FROM C GROUP BY threshold),
"""


SWEEP = sweep("0.10", "0.05", 18)

IDS = "s1 AS source1_entity_id, cand AS candidate_entity_id"

SQL: dict[str, str] = {
    "scan_records": sql("SELECT entity_id, business_name, business_address, country FROM R", RECORDS),
    "source_tag": sql("SELECT CAST(src AS BIGINT) AS source, count(*) AS n FROM R GROUP BY 1", RECORDS),
    "country_counts": sql("SELECT country, count(*) AS n, round(count(*) * 1.0 / sum(count(*)) OVER (), 6) AS share FROM R GROUP BY 1", RECORDS),
    "missing_profile": sql(
        "SELECT CAST(src AS BIGINT) AS source, count(*) AS n, CAST(sum(CASE WHEN lower(trim(business_name)) IN ('', 'nan', 'null', 'none', '<na>') THEN 1 ELSE 0 END) AS BIGINT) AS no_name, "
        "CAST(sum(CASE WHEN lower(trim(business_address)) IN ('', 'nan', 'null', 'none', '<na>') THEN 1 ELSE 0 END) AS BIGINT) AS no_address FROM R GROUP BY 1",
        RECORDS,
    ),
    "length_profile": sql(
        "SELECT country, round(avg(length(business_name)), 6) AS mean_name, CAST(max(length(business_name)) AS BIGINT) AS max_name, "
        "round(avg(length(business_address)), 6) AS mean_address, CAST(max(length(business_address)) AS BIGINT) AS max_address FROM R GROUP BY 1",
        RECORDS,
    ),
    "duplicate_name_addr": sql("SELECT country, business_name, business_address, count(*) AS n FROM R GROUP BY ALL HAVING count(*) > 1", RECORDS),
    "tsv_round_trip": sql("SELECT entity_id, business_name, business_address, country FROM R", RECORDS),
    "parquet_merge": sql("SELECT entity_id, country FROM R WHERE src > 1", RECORDS),
    "first_ids": sql("SELECT DISTINCT entity_id FROM R WHERE src = 1", RECORDS),
    "ground_truth_pairs": sql(f"SELECT {IDS} FROM T", RECORDS),
    "match_count_buckets": sql(f"SELECT {BUCKET} AS match_bucket, count(*) AS n FROM G GROUP BY 1", RECORDS),
    "match_distribution": sql("SELECT n AS match_count, count(*) AS n FROM G GROUP BY 1", RECORDS),
    "stratum_shares": sql(f"SELECT country || '_' || {BUCKET} AS stratum, count(*) AS n, round(count(*) * 1.0 / sum(count(*)) OVER (), 6) AS share FROM G GROUP BY 1", RECORDS),
    "stratified_split": sql(
        f"""SELECT s1 AS source1_entity_id, country, stratum FROM (
          SELECT *, row_number() OVER (ORDER BY side, o, s1) AS pick FROM (
            SELECT *, CASE WHEN r <= want AND row_number() OVER (PARTITION BY r <= want ORDER BY o, s1) <= 100 THEN 0 ELSE 1 END AS side FROM (
              SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY o, s1) AS r, round_even(count(*) OVER (PARTITION BY stratum) * (100.0 / count(*) OVER ()), 0) AS want
              FROM (SELECT s1, country, country || '_' || {BUCKET} AS stratum, md5(s1 || '42') AS o FROM G)))) WHERE pick <= 100""",
        RECORDS,
    ),
    "uniform_sample": sql("SELECT entity_id FROM R ORDER BY md5(entity_id || '42'), entity_id LIMIT 50", RECORDS),
    "semi_join_val": sql("SELECT entity_id FROM R WHERE src = 1 AND entity_id IN (SELECT s1 FROM T)", RECORDS),
    "anti_join_train": sql("SELECT entity_id FROM R WHERE src = 1 AND entity_id NOT IN (SELECT s1 FROM T)", RECORDS),
    "union_catalogues": sql("SELECT country, CAST(src AS BIGINT) AS source, count(*) AS n FROM R WHERE src > 1 GROUP BY ALL", RECORDS),
    "normalize_names": sql("SELECT entity_id, n_norm FROM M", RECORDS, NORM),
    "normalize_addresses": sql("SELECT entity_id, a_norm FROM M", RECORDS, NORM),
    "keys_name": sql("SELECT entity_id, key, CAST(pos AS BIGINT) AS pos FROM K WHERE strategy = 'name_tokens'", RECORDS, KEYS),
    "keys_prefix": sql("SELECT entity_id, key, CAST(pos AS BIGINT) AS pos FROM K WHERE strategy = 'char_ngrams'", RECORDS, KEYS),
    "keys_soundex": sql("SELECT entity_id, key, CAST(pos AS BIGINT) AS pos FROM K WHERE strategy = 'phonetic'", RECORDS, KEYS),
    "keys_address": sql("SELECT entity_id, key, CAST(pos AS BIGINT) AS pos FROM K WHERE strategy = 'address'", RECORDS, KEYS),
    "posting_df": sql("SELECT country, strategy, key, df FROM D", RECORDS, KEYS),
    "posting_idf": sql("SELECT country, strategy, key, round(idf, 6) AS idf FROM I", RECORDS, KEYS),
    "hot_keys": sql(f"SELECT country, strategy, key, df FROM D WHERE df > {CAPS} / 100", RECORDS, KEYS),
    **{
        name: sql(f"SELECT {IDS}, round(score, 6) AS blocking_score, rnk AS candidate_rank FROM P", RECORDS, KEYS, pairs(k, chosen))
        for name, k, chosen in (
            ("block_token", 50, ("name_tokens",)),
            ("block_prefix", 50, ("char_ngrams",)),
            ("block_phonetic", 50, ("phonetic",)),
            ("block_address", 50, ("address",)),
            ("block_all_topk", 50, rules.STRATEGIES),
            ("stream_probe", 50, rules.STRATEGIES),
        )
    },
    "strategy_recall": sql(
        """SELECT strategy, CAST(sum(f) AS BIGINT) AS found, count(*) AS total, round(sum(f) * 1.0 / count(*), 6) AS recall FROM (
          SELECT T.s1, T.cand, st.strategy, CASE WHEN EXISTS (SELECT 1 FROM K q JOIN K c ON q.country = c.country AND q.strategy = c.strategy AND q.key = c.key
              WHERE q.entity_id = T.s1 AND c.entity_id = T.cand AND (st.strategy = 'union' OR q.strategy = st.strategy)) THEN 1 ELSE 0 END AS f
          FROM T CROSS JOIN (VALUES ('name_tokens'), ('char_ngrams'), ('phonetic'), ('address'), ('union')) st(strategy)) GROUP BY 1""",
        RECORDS,
        KEYS,
    ),
    "recall_at_k": sql(
        "SELECT k, count(*) FILTER (WHERE rnk <= k) AS found, count(*) AS total, round(count(*) FILTER (WHERE rnk <= k) * 1.0 / count(*), 6) AS recall "
        "FROM T LEFT JOIN P USING (s1, cand) CROSS JOIN (VALUES (10), (20), (30), (40), (50), (75)) v(k) GROUP BY 1",
        *BLOCK,
    ),
    "recall_at_k_by_bucket": sql(
        f"SELECT match_bucket, k, count(*) FILTER (WHERE rnk <= k) AS found, count(*) AS total, round(count(*) FILTER (WHERE rnk <= k) * 1.0 / count(*), 6) AS recall "
        f"FROM (SELECT T.s1, T.cand, {BUCKET} AS match_bucket FROM T JOIN G USING (s1)) LEFT JOIN P USING (s1, cand) CROSS JOIN (VALUES (10), (20), (30), (40), (50), (75)) v(k) GROUP BY ALL",
        *BLOCK,
    ),
    "reduction_ratio": sql(
        "SELECT (SELECT count(*) FROM P) AS pairs, CAST(sum(a.n * b.n) AS BIGINT) AS brute_force, round(1 - (SELECT count(*) FROM P) * 1.0 / sum(a.n * b.n), 6) AS reduction_ratio "
        "FROM (SELECT country, count(*) AS n FROM R WHERE src = 1 GROUP BY 1) a JOIN N b USING (country)",
        *BLOCK,
    ),
    "sim_levenshtein": sql(f'SELECT {IDS}, {chosen("name_lev_sim", "addr_lev_sim")} FROM La', *SIDED),
    "sim_jaro_winkler": sql(f'SELECT {IDS}, {chosen("name_jw_sim", "addr_jw_sim")} FROM La', *SIDED),
    "sim_token_jaccard": sql(f'SELECT {IDS}, {chosen("name_word_jaccard", "addr_word_jaccard", "name_common_tokens", "addr_common_tokens")} FROM La', *SIDED),
    "len_features": sql(f'SELECT {IDS}, {chosen("name_len_ratio", "name_len_diff", "addr_len_diff")} FROM La', *SIDED),
    "sim_char3_jaccard": sql(f'SELECT {IDS}, {chosen("name_char3_jaccard")} FROM La', *SIDED),
    "digit_overlap": sql(f'SELECT {IDS}, {chosen("digits_jaccard", "digits_overlap")} FROM La', *SIDED),
    "exact_flags": sql(f'SELECT {IDS}, {chosen("name_exact_clean", "name_exact_raw", "addr_exact_norm", "postal_exact", "street_num_exact")} FROM La', *SIDED),
    "meta_features": sql(f'SELECT {IDS}, {chosen("score_gap_to_top", "candidate_rank", "candidate_count", "is_source2", "is_source3")} FROM La', *SIDED),
    "label_balance": sql(
        "SELECT count(*) AS n, count(T.cand) AS n_positive, round(count(T.cand) * 1.0 / count(*), 6) AS positive_rate, "
        "round((count(*) - count(T.cand)) * 1.0 / greatest(count(T.cand), 1), 6) AS scale_pos_weight FROM P LEFT JOIN T USING (s1, cand)",
        *BLOCK,
    ),
    "feature_label_corr": sql(
        "SELECT 'candidate_rank' AS feature, round(corr(rnk, CASE WHEN T.cand IS NULL THEN 0 ELSE 1 END), 5) AS correlation FROM P LEFT JOIN T USING (s1, cand) "
        "UNION ALL SELECT 'is_source2', round(corr(CASE WHEN csrc = 2 THEN 1 ELSE 0 END, CASE WHEN T.cand IS NULL THEN 0 ELSE 1 END), 5) FROM P LEFT JOIN T USING (s1, cand)",
        *BLOCK,
    ),
    "entity_f05": sql(f"SELECT s1 AS source1_entity_id, tp, n_true, n_pred, round({PREC}, 6) AS precision, round({REC}, 6) AS recall, round({F05}, 6) AS f FROM Q", *BLOCK, COUNTS),
    "macro_metrics": sql(f"SELECT {MACRO} FROM Q", *BLOCK, COUNTS),
    "threshold_sweep": sql("SELECT * FROM V", *BLOCK, SWEEP),
    "best_threshold": sql("SELECT * FROM V ORDER BY macro_f05 DESC, threshold LIMIT 1", *BLOCK, SWEEP),
    "ranking_quality": sql(
        f"""SELECT round(sum(neg * (tp - pos / 2.0)) / (sum(pos) * sum(neg)), 6) AS roc_auc, round(sum(pos * tp * 1.0 / seen) / sum(pos), 6) AS average_precision FROM (
          SELECT pos, n - pos AS neg, sum(pos) OVER (ORDER BY sc DESC) AS tp, sum(n) OVER (ORDER BY sc DESC) AS seen FROM (
            SELECT {SCORE} AS sc, count(T.cand) AS pos, count(*) AS n FROM P LEFT JOIN T USING (s1, cand) GROUP BY 1))""",
        *BLOCK,
    ),
    "blend_scores": sql(f"SELECT {IDS}, round(0.6 * {SCORE} + 0.4 * (1.0 / rnk), 6) AS score FROM P", *BLOCK),
    "match_lists": sql(
        f"SELECT r.entity_id AS source1_entity_id, coalesce(string_agg(P.cand, ',' ORDER BY P.cand), '') AS matched_entity_ids FROM R r LEFT JOIN P ON P.s1 = r.entity_id AND {SCORE} >= 0.75 WHERE r.src = 1 GROUP BY 1",
        *BLOCK,
    ),
    "candidate_lists": sql(
        "SELECT r.entity_id AS source1_entity_id, coalesce(string_agg(P.cand, ',' ORDER BY P.rnk), '') AS candidate_entity_ids FROM R r LEFT JOIN P ON P.s1 = r.entity_id WHERE r.src = 1 GROUP BY 1",
        *BLOCK,
    ),
    "recall_at_k_by_country": sql(
        "SELECT country, k, count(*) FILTER (WHERE rnk <= k) AS found, count(*) AS total, round(count(*) FILTER (WHERE rnk <= k) * 1.0 / count(*), 6) AS recall "
        "FROM (SELECT T.s1, T.cand, G.country FROM T JOIN G USING (s1)) LEFT JOIN P USING (s1, cand) CROSS JOIN (VALUES (10), (20), (30), (40), (50), (75)) v(k) GROUP BY ALL",
        *BLOCK,
    ),
    "threshold_sweep_fine": sql("SELECT * FROM V", *BLOCK, sweep("0.92", "0.005", 16)),
    "truth_classes": sql(
        "SELECT country, md5(text) AS digest, CAST(count(*) FILTER (WHERE src = 1) AS BIGINT) AS n_source1, CAST(count(*) FILTER (WHERE src > 1) AS BIGINT) AS n_candidates, "
        "min(entity_id) AS first FROM R GROUP BY country, md5(text) HAVING count(*) FILTER (WHERE src = 1) > 0 AND count(*) FILTER (WHERE src > 1) > 0",
        RECORDS,
    ),
    "first_per_country": sql(f"SELECT s1 AS source1_entity_id, country FROM (SELECT *, row_number() OVER (PARTITION BY country ORDER BY s1) AS r FROM G) WHERE r <= 25", RECORDS),
    "block_capped": sql(f"SELECT {IDS}, round(score, 6) AS blocking_score, rnk AS candidate_rank FROM P", RECORDS, KEYS, pairs(50, caps=LOW_CAPS)),
    "normalized_records": sql(NORMALIZED, RECORDS, NORM),
    "sim_token_ratios": sql(f'SELECT {IDS}, {chosen("name_token_sort", "name_token_set", "addr_token_sort", "addr_token_set")} FROM La', *SIDED),
    "missing_flags": sql(f"SELECT {IDS}, {chosen(*MISSING_FLAGS)} FROM La", *SIDED),
    "pair_features_full": sql(f"SELECT {IDS}, {ALL_FEATURES}, {LABEL} FROM La", *SIDED),
    "clipped_features": sql(f"SELECT {IDS}, least(candidate_rank, 10) AS candidate_rank, least(candidate_count, 20) AS candidate_count FROM (SELECT s1, cand, {chosen('candidate_rank', 'candidate_count')} FROM La)", *SIDED),
    "feature_audit": sql(
        f"""SELECT feature, round(r, 4) AS correlation, CASE WHEN r IS NULL THEN 'constant' WHEN abs(r) < 0.01 THEN 'near zero' WHEN r > 0.30 THEN 'strong positive' WHEN r > 0.10 THEN 'moderate positive'
          WHEN r < -0.10 THEN 'negative' ELSE 'weak' END AS status, row_number() OVER (ORDER BY round(r, 9) DESC NULLS LAST, feature) AS place
        FROM (SELECT feature, CASE WHEN max(v) = min(v) THEN NULL ELSE corr(v, label) END AS r FROM (UNPIVOT (SELECT label, {", ".join(f"CAST({name} AS DOUBLE) AS {name}" for name in FEATURE_SQL)} FROM F) ON COLUMNS(* EXCLUDE (label)) INTO NAME feature VALUE v) GROUP BY feature)""",
        *SIDED,
        f"F AS (SELECT {ALL_FEATURES}, {LABEL} FROM La),",
    ),
    "matched_not_candidates": sql("SELECT s1 AS s1, count(*) AS missing FROM T WHERE NOT EXISTS (SELECT 1 FROM P WHERE P.s1 = T.s1 AND P.cand = T.cand AND P.rnk <= 1) GROUP BY s1", *BLOCK),
    "validate_lists": sql(
        """SELECT "check", count(*) AS n, array_to_string(list_sort(list(x))[1:5], ', ') AS examples FROM B GROUP BY 1""",
        RECORDS,
        """
Y AS (SELECT r.entity_id AS s1, r.doc_id, r.doc_id // 20 % 16 AS turn, coalesce(string_agg(T.cand, ',' ORDER BY T.cand), '') AS own FROM R r LEFT JOIN T ON T.s1 = r.entity_id WHERE r.src = 1 GROUP BY ALL),
Z AS (SELECT turn, CASE WHEN turn = 7 THEN 'S1-extra' || doc_id ELSE s1 END AS s1, s1 AS whole,
        CASE turn WHEN 2 THEN s1 || CASE WHEN own = '' THEN '' ELSE ',' || own END WHEN 3 THEN 'S2-none' || doc_id WHEN 4 THEN 'X-' || doc_id WHEN 5 THEN 'S3-none,S3-none' ELSE own END AS ids FROM Y WHERE turn <> 0),
B AS (SELECT 'malformed_row' AS "check", 'no tab ' || whole AS x FROM Z WHERE turn = 6
  UNION ALL SELECT 'duplicate_row', s1 FROM Z WHERE turn = 1
  UNION ALL SELECT 'duplicate_in_list', s1 FROM Z WHERE turn = 5
  UNION ALL SELECT 'self_match', whole FROM Z WHERE turn = 2
  UNION ALL SELECT 'wrong_prefix', ids FROM Z WHERE turn = 4
  UNION ALL SELECT DISTINCT 'unknown_id', CASE WHEN turn = 5 THEN 'S3-none' ELSE ids END FROM Z WHERE turn IN (3, 5)
  UNION ALL SELECT 'missing_row', s1 FROM Y WHERE turn IN (0, 6, 7)
  UNION ALL SELECT 'extra_row', s1 FROM Z WHERE turn = 7),
""",
    ),
    "dressed_records": sql("SELECT entity_id, business_name, business_address, country FROM R", DRESSED),
    "dressed_normalized": sql(NORMALIZED, DRESSED, NORM),
    "dressed_keys": sql("SELECT entity_id, strategy, key, CAST(pos AS BIGINT) AS pos FROM K", DRESSED, KEYS),
    "dressed_blocking": sql(f"SELECT {IDS}, round(score, 6) AS blocking_score, rnk AS candidate_rank FROM P", DRESSED, KEYS, pairs(50, caps=LOW_CAPS)),
    "dressed_features": sql(f"SELECT {IDS}, {ALL_FEATURES} FROM La", DRESSED, KEYS, pairs(20, caps=LOW_CAPS), NORM, SIDES, RATIOS),
    "validate_results": """SELECT * FROM (VALUES ('duplicate_in_list', CAST(1 AS BIGINT), 'S1-2'), ('duplicate_row', 1, 'S1-3'), ('extra_row', 1, 'S1-9'), ('malformed_row', 1, 'no tab here'),
      ('missing_row', 1, 'S1-4'), ('self_match', 1, 'S1-1'), ('unknown_id', 1, 'S2-404'), ('wrong_prefix', 1, 'X-7')) v("check", n, examples)""",
}
