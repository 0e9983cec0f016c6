"""Text rules in DuckDB's SQL, for comparison; written over RE2, which has word boundaries but no look-around."""

from __future__ import annotations

from concord import vocab

# The words and patterns of concord.functions.text, which files are named by, in DuckDB's syntax.
W = "remix|edit|mix|bootleg|flip|vip|version|rework"
MIX = rf"[\(\[]\s*([^)\]]*\b(?:{W})\b[^)\]]*)\s*[\)\]]"
DASH = rf"\s+[-–]\s+([^-–]*\b(?:{W})\b[^-–]*)$"


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sub(x: str, pattern: str, to: str = "", flags: str = "g") -> str:
    return f"regexp_replace({x}, {q(pattern)}, {q(to)}, '{flags}')"


def squeeze(x: str) -> str:
    return f"trim({sub(x, r'\s+', ' ')})"


def key(x: str) -> str:
    return sub(f"lower({x})", r"[^\p{L}\p{N}]")


def first_cut(x: str, pattern: str) -> str:
    return sub(x, rf"(?is)^(.*?){pattern}(.*)$", r"\1\3", "")


def before(x: str, pattern: str) -> str:
    return sub(x, rf"(?is)^(.*?){pattern}.*$", r"\1", "")


def strip_version(x: str) -> str:
    t = squeeze(x)
    cut = f"CASE WHEN regexp_matches({t}, {q('(?i)' + MIX)}) THEN {first_cut(t, MIX)} ELSE {before(t, DASH)} END"
    return sub(sub(cut, r"\s+", " "), r"^[ \-–]+|[ \-–]+$")


def album_key(x: str) -> str:
    words = "|".join(vocab.DELUXE_WORDS)
    t = sub(sub(x, rf"(?i)\s*[\(\[][^)\]]*\b(?:{words}|version|edition)\b[^)\]]*[\)\]]\s*$"), r"(?i)\s*[-–—]\s*(?:single|ep)\s*$")
    for pattern in (r"\s+\d+\.\d+\s*$", rf"(?i)\s+(?:{words}|remastered|reissue)(?:\s+(?:edition|version))?\s*$"):
        t = sub(sub(t, pattern), pattern)
    return key(t)


def names(x: str) -> str:
    return f"list_filter(list_transform(regexp_split_to_array({x}, {q(r'(?i)\s*(?:;|&|,| x |\bvs\b\.?|\band\b)\s*')}), lambda n: trim(n)), lambda n: n <> '')"


def core_key(field: str, x: str) -> str:
    return f"CASE WHEN {field} = 'artist' THEN {key(f'coalesce(({names(x)})[1], {x})')} ELSE {key(sub(x, r'\s*[\(\[][^)\]]*[\)\]]'))} END"


def tidy(x: str) -> str:
    return squeeze(f"translate({x}, '’‘“”–—_', '''''\"\"-- ')")


def house_title(source: str, title: str, keep: str) -> str:
    """CTEs t1 to t4, the last with a column house; source names a relation with the title and the columns to keep."""
    contractions = f"translate({title}, '’‘“”‐‑–—', '''''\"\"----')"
    for end in ("ll", "re", "ve", "s", "t", "d", "m", "n"):
        contractions = sub(contractions, rf"(?i)(['’]){end}\b", rf"\1{end}")
    film = r"""(?i)\s*[\(\[]\s*from\s+(?:["“‘'].*?|the\s+(?:motion\s+picture|film|movie|series|soundtrack|album)\b.*?)\s*[\)\]]\s*$"""
    box, bare = r"[\(\[]\s*ft\.\s*([^)\]]+)\s*[\)\]]", r"\bft\.\s+(.+)$"
    return f"""
t1 AS (SELECT {keep}, trim({sub(squeeze(contractions), film)}) AS t FROM {source}),
t2 AS (SELECT {keep}, CASE WHEN regexp_matches(t, {q('(?i)' + MIX)}) THEN trim(regexp_extract(t, {q('(?i)' + MIX)}, 1)) ELSE trim(regexp_extract(t, {q('(?i)' + DASH)}, 1)) END AS mix,
       {sub(f"CASE WHEN regexp_matches(t, {q('(?i)' + MIX)}) THEN {first_cut('t', MIX)} ELSE {before('t', DASH)} END", r'(?i)\b(?:feat\.?|featuring|ft\.?)\s+', 'ft. ')} AS t FROM t1),
t3 AS (SELECT {keep}, mix, CASE WHEN regexp_matches(t, {q('(?i)' + box)}) THEN trim(regexp_extract(t, {q('(?i)' + box)}, 1)) ELSE trim(regexp_extract(t, {q(bare)}, 1)) END AS feat,
       CASE WHEN regexp_matches(t, {q('(?i)' + box)}) THEN {first_cut('t', box)} ELSE {before('t', bare)} END AS t FROM t2),
t4 AS (SELECT {keep}, {sub(sub('t', r'\s+', ' '), r'^[ \-–]+|[ \-–]+$')} || CASE WHEN feat <> '' THEN ' (ft. ' || feat || ')' ELSE '' END || CASE WHEN mix <> '' THEN ' [' || mix || ']' ELSE '' END AS house FROM t3)"""


def safe(x: str) -> str:
    t = squeeze(sub(f"trim({x})", r"[/:\x00-\x1f]", "-"))
    return f"CASE WHEN regexp_matches({t}, '^\\.*$') THEN 'unknown' ELSE trim(left({t}, 120)) END"
