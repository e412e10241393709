"""Synthetic pairs: entities drawn by md5 of (seed, entity, stream), and a table of cases that say what a copy changes.

A row's draw depends on nothing but its number, so the corpus is the same for any
partitioning and each pair is one projection: no state, no join, no shuffle. A match is
an entity and a changed copy of itself; a non-match is two entities, some of whose
fields are forced to be equal.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.functions.similarity import NICKNAMES
from pairloom.functions.text import filtered_token
from pairloom.operators.schema import FEATURES, RENAMES

MEN = ["JAMES", "ROBERT", "MICHAEL", "DAVID", "JOSE", "DANIEL", "ANTHONY", "CHRISTOPHER", "THOMAS", "CHARLES", "MANUEL", "FRANCISCO", "MATTHEW", "RICHARD", "JOSEPH", "WILLIAM"]
WOMEN = ["MARIA", "PATRICIA", "JENNIFER", "ELIZABETH", "GUADALUPE", "ROSA", "JESSICA", "MARGARET", "STEPHANIE", "TERESA", "KATHERINE", "DOLORES", "MERCEDES", "ROSARIO", "LINDA", "KAREN"]
SURNAMES = ["GARCIA", "SMITH", "JOHNSON", "RODRIGUEZ", "MARTINEZ", "WILLIAMS", "HERNANDEZ", "BROWN", "LOPEZ", "GONZALEZ", "JONES", "PEREZ", "DAVIS", "MILLER", "SANCHEZ", "WILSON", "RAMIREZ", "ANDERSON", "TORRES", "TAYLOR", "FLORES", "THOMAS", "RIVERA", "JACKSON", "GOMEZ", "WHITE", "DIAZ", "HARRIS", "NGUYEN", "KOWALSKI", "PATEL", "OBRIEN"]
STREETS = ["MAIN", "OAK", "WASHINGTON", "LAKE", "HALSTED", "ASHLAND", "CLARK", "STATE", "CEDAR", "PARK"]
KINDS = ["ST", "AVE", "RD", "DR", "BLVD"]
PLACES = [("CHICAGO", "IL", "606"), ("AURORA", "IL", "605"), ("CICERO", "IL", "608"), ("ELGIN", "IL", "601"), ("GARY", "IN", "464")]
AREAS = ["773", "312", "872", "224", "847", "708", "630", "815"]
DOMAINS = ["GMAIL.COM", "YAHOO.COM", "HOTMAIL.COM", "AOL.COM"]


#: Area codes by region; other states have those of Illinois outside Chicago.
AREA_CODES = {
    "CHICAGO": ["773", "312", "872", "224", "847", "708", "630", "815", "331", "464"], "IL_OTHER": ["847", "708", "630", "815", "224", "331"], "KY": ["859", "502", "606", "270"], "HI": ["808"], "WY": ["307"],
    "MD": ["410", "443", "240", "301"], "NY": ["646", "347", "718", "212", "607", "315", "917"], "IN": ["219", "765", "574", "317"], "CA": ["530", "916", "415", "510"],
}
#: How often each field differs between two records of one entity.
DIFFER_RATES = {"last_name": 0.28, "first_name": 0.12, "middle_change": 0.16, "middle_one_missing": 0.22, "dob": 0.13, "address_move": 0.70, "phone_no_overlap": 0.65, "email": 0.43, "sex": 0.015}
#: Shares of entities with 1 to 5 records, by identifier band.
RECORDS_OF = {"full_ssn": (0.874, 0.111, 0.013, 0.0015, 0.0005), "last4": (0.816, 0.143, 0.031, 0.0085, 0.0015), "no_ssn": (0.838, 0.130, 0.025, 0.005, 0.002)}
UNISEX = ("GUADALUPE",)


def name_gender(name: Column) -> Column:
    """MALE or FEMALE by the first word of a given name of the pools, null for others and for names of both."""
    word = F.upper(F.split_part(F.trim(name), F.lit(" "), F.lit(1)))
    known = lambda pool: word.isin(*[n for n in pool if n not in UNISEX])
    return F.when(known(WOMEN), "FEMALE").when(known(MEN), "MALE")


def region_for(city: Column, state: Column) -> Column:
    """The phone region of a place; a null place is somewhere in Illinois."""
    chicago = F.when(city == "CHICAGO", "CHICAGO").otherwise("IL_OTHER")
    return F.when(state == "IL", chicago).when(state.isin(*AREA_CODES), state).otherwise("IL_OTHER")


def band_of(ssn: Column, last4: Column) -> Column:
    return F.when(ssn.isNotNull(), "full_ssn").when(last4.isNotNull(), "last4").otherwise("no_ssn")


def u(stream: str, eid: str, seed: int) -> str:
    """SQL of a number of [0, 1) for an entity and stream."""
    return f"(conv(substr(md5(concat('{seed}:', {eid}, ':{stream}')), 1, 8), 16, 10) / 4294967296.0D)"


def pick(values: list[str], x: str) -> str:
    return f"element_at(array({', '.join(repr(v) for v in values)}), 1 + cast(floor({x} * {len(values)}) as int))"


def entity(eid: str, seed: int) -> dict[str, str]:
    """SQL of each field of an entity."""
    r = lambda s: u(s, eid, seed)
    born = f"make_date(cast(least(2025, greatest(1900, 1920 + floor({r('decade')} * 10) * 10 + floor({r('year')} * 10))) as int), 1 + cast(floor({r('month')} * 12) as int), 1 + cast(floor({r('day')} * 28) as int))"
    place = lambda k: pick([p[k] for p in PLACES], f"pow({r('place')}, 2)")
    woman = f"{r('sex')} < 0.52"
    first = f"CASE WHEN {woman} THEN {pick(WOMEN, f'pow({r("first")}, 1.5)')} ELSE {pick(MEN, f'pow({r("first")}, 1.5)')} END"
    last = pick(SURNAMES, f"pow({r('last')}, 1.5)")
    serial = lambda s, a, b: f"lpad(cast(cast({a} + floor({r(s)} * {b - a + 1}) as int) as string), 4, '0')"
    ssn = f"concat(lpad(cast(cast(1 + floor({r('area')} * 664) as int) as string), 3, '0'), lpad(cast(cast(1 + floor({r('group')} * 99) as int) as string), 2, '0'), {serial('serial', 1, 9999)})"
    phone = lambda s: f"concat({pick(AREAS, r(s + 'a'))}, cast(cast(2 + floor({r(s + 'x')} * 3) as int) as string), cast(cast(20 + floor({r(s + 'y')} * 80) as int) as string), {serial(s + 'n', 0, 9999)})"
    return {
        "first_name": first, "middle_name": f"CASE WHEN {r('hasmiddle')} < 0.2 THEN substr({pick(MEN + WOMEN, r('middle'))}, 1, CASE WHEN {r('fullmiddle')} < 0.8 THEN 1 ELSE 20 END) END",
        "last_name": f"CASE WHEN {r('two')} < 0.06 THEN concat({last}, ' ', {pick(SURNAMES, r('last2'))}) ELSE {last} END", "suffix": f"CASE WHEN {r('suffix')} < 0.004 THEN 'JR' END",
        "dob": f"cast({born} as string)", "ssn": ssn, "ssn4": f"right({ssn}, 4)", "sex": f"CASE WHEN {r('hassex')} < 0.79 THEN CASE WHEN {woman} THEN 'FEMALE' ELSE 'MALE' END END",
        "address": f"concat(cast(cast(1 + floor({r('house')} * 9899) as int) as string), ' ', {pick(STREETS, r('street'))}, ' ', {pick(KINDS, r('kind'))})",
        "address2": f"CASE WHEN {r('hasunit')} < 0.29 THEN concat('APT ', cast(cast(1 + floor({r('unit')} * 40) as int) as string)) END",
        "city": place(0), "state": place(1), "zip": f"concat({place(2)}, lpad(cast(cast(floor({r('zip')} * 60) as int) as string), 2, '0'))",
        "phone": f"array_join(array_sort(CASE WHEN {r('phones')} < 0.35 THEN array_distinct(array({phone('p')}, {phone('q')})) ELSE array({phone('p')}) END), ' ')",
        "email": f"CASE WHEN {r('hasemail')} < 0.31 THEN concat(replace(substr({first}, 1, 8), ' ', ''), cast(cast(floor({r('mail')} * 99999) as int) as string), '@', {pick(DOMAINS, r('domain'))}) END",
    }


# changes: field -> SQL over the fields of the record, and of a spare entity under s_<field>

NULL = "CAST(NULL AS string)"
NO_ID = {"ssn": NULL, "ssn4": NULL}
LAST4 = {"ssn": NULL}
THIN = {f: NULL for f in ("address", "address2", "phone", "email")}


def typo(f: str) -> str:
    """By a draw: two letters swapped, one doubled, one lost, or one replaced; short values are doubled at the end."""
    x = f"CASE WHEN length({f}) < 4 THEN concat({f}, right({f}, 1)) WHEN d < 0.25 AND substr({f}, 2, 1) <> substr({f}, 3, 1) THEN concat(substr({f}, 1, 1), substr({f}, 3, 1), substr({f}, 2, 1), substr({f}, 4)) WHEN d < 0.5 THEN concat(substr({f}, 1, 3), substr({f}, 3)) WHEN d < 0.75 THEN concat(substr({f}, 1, 2), substr({f}, 4)) ELSE concat(substr({f}, 1, 2), CASE WHEN substr({f}, 3, 1) = 'X' THEN 'Y' ELSE 'X' END, substr({f}, 4)) END"
    return f"({x})"


def shift_days(n: int) -> str:
    return f"cast(date_add(cast(dob as date), {n}) as string)"


def shift_years(lo: int, hi: int) -> str:
    return f"cast(add_months(cast(dob as date), 12 * cast({lo} + floor(d * {hi - lo + 1}) as int)) as string)"


MOVE = {"address": "s_address", "address2": "s_address2", "zip": "s_zip", "city": "s_city", "state": "s_state"}
MOVE_NEAR = {"address": "s_address", "zip": "CASE WHEN right(zip, 2) = '01' THEN concat(substr(zip, 1, 3), '02') ELSE concat(substr(zip, 1, 3), '01') END"}
SWAP_DAY = "CASE WHEN cast(substr(dob, 9, 2) as int) <= 12 AND substr(dob, 6, 2) <> substr(dob, 9, 2) THEN concat(substr(dob, 1, 5), substr(dob, 9, 2), '-', substr(dob, 6, 2)) ELSE " + shift_days(370) + " END"
DRIFT = f"CASE WHEN d < 0.4 THEN {shift_days(1)} WHEN d < 0.7 THEN cast(add_months(cast(dob as date), 12) as string) WHEN d < 0.85 THEN {SWAP_DAY} ELSE {shift_days(400)} END"
NICK = "CASE " + " ".join(f"WHEN first_name = '{n}' THEN '{f[0]}'" for n, f in NICKNAMES.items()) + " ELSE substr(first_name, 1, 4) END"
OTHER_MAIL = "concat('NEW', coalesce(substr(s_email, 1, 40), 'X@AOL.COM'))"
OTHER_PHONE = {"phone": "CASE WHEN s_phone = phone THEN '3125550100' ELSE s_phone END"}
CHILD = {"dob": "cast(date_add(date '2012-01-01', cast(floor(d * 4000) as int)) as string)", "email": NULL}
TWO = "split_part(last_name, ' ', 1)"
SECOND = "CASE WHEN s_last_name LIKE '% %' THEN split_part(s_last_name, ' ', 2) ELSE s_last_name END"
WITH_MAIL = {"email": "coalesce(email, concat(substr(first_name, 1, 8), '7@GMAIL.COM'))"}
LONG_NAME = {"last_name": "'VILLARREAL'"}

#: Matches: band, changes of both records, changes of the copy.
MATCHES: dict[str, tuple[str, dict[str, str], dict[str, str]]] = {
    "M-NOSSN-01": ("control", NO_ID, {}), "M-NOSSN-02": ("none", NO_ID, MOVE), "M-NOSSN-03": ("none", NO_ID, MOVE), "M-NOSSN-04": ("none", NO_ID | THIN, {"first_name": typo("first_name")}),
    "M-NOSSN-05": ("none", NO_ID, {"last_name": typo("last_name")}), "POL-AMBIG-03": ("ambiguous", NO_ID, OTHER_PHONE | {"email": f"CASE WHEN d < 0.5 AND email IS NOT NULL THEN {OTHER_MAIL} ELSE email END"}),
    "M-SSN-01": ("control", {}, {}), "M-SSN-02": ("full", {}, {"last_name": typo("last_name"), "first_name": typo("first_name")}), "M-SSN-03": ("full", {"middle_name": "coalesce(middle_name, 'L')"}, {"middle_name": NULL} | MOVE_NEAR),
    "M-SSN-04": ("full", {"sex": "'FEMALE'", "first_name": "'LINDA'"}, {"last_name": f"CASE WHEN s_last_name = last_name THEN 'NEWMAN' ELSE s_last_name END"}), "M-SSN-05": ("full", {}, MOVE), "M-SSN-06": ("full", {}, {"address": "s_address", "city": "'GARY'", "state": "'IN'", "zip": "'46402'"}),
    "M-SSN-07": ("full", WITH_MAIL, OTHER_PHONE | {"email": OTHER_MAIL} | {"address": typo("address")}), "M-SSN-08": ("full", {}, {"dob": DRIFT}), "M-SSN-09": ("last4", {}, {"ssn": NULL} | MOVE_NEAR), "M-SSN-10": ("control", {}, NO_ID),
    "M-SSN-11": ("full", {}, {"last_name": typo("last_name"), "middle_name": NULL, "dob": DRIFT} | MOVE | OTHER_PHONE), "M-L4-01": ("control", LAST4, {}), "M-L4-02": ("last4", LAST4, {"last_name": typo("last_name")}), "M-L4-03": ("last4", LAST4, {"dob": DRIFT}),
    "M-L4-ASYM": ("control", {}, {"ssn": NULL}), "M-L4-04": ("last4", {}, {"ssn": NULL, "last_name": typo("last_name")}), "M-NAME-01": ("none", NO_ID | {"first_name": "'ANNE-MARIE'"}, {"first_name": "CASE WHEN d < 0.5 THEN 'ANNE MARIE' ELSE 'ANNEMARIE' END"} | MOVE_NEAR),
    "M-NAME-02": ("none", NO_ID | {"middle_name": "CASE WHEN first_name = 'LEE' THEN 'RAY' ELSE 'LEE' END"}, {"first_name": "middle_name", "middle_name": "first_name"}), "M-NAME-03": ("none", NO_ID | {"middle_name": TWO, "last_name": SECOND}, {"middle_name": NULL, "last_name": "concat(middle_name, ' ', last_name)"}),
    "M-NAME-04": ("none", NO_ID | {"last_name": f"concat({TWO}, ' ', {SECOND})"}, {"last_name": TWO}), "M-NAME-05": ("none", NO_ID | {"first_name": "'MINH'", "last_name": "'TRAN'", "middle_name": NULL}, {"first_name": "'TRAN'", "last_name": "'MINH'"}),
    "M-NAME-06": ("none", NO_ID | {"middle_name": "'ALBERTO'"}, {"middle_name": "'A'"} | MOVE_NEAR), "M-NAME-07": ("none", NO_ID | {"first_name": "concat(substr(first_name, 1, 20), ' LUZ')"}, {"first_name": "replace(first_name, ' LUZ', '')"}), "M-NAME-08": ("none", NO_ID | {"last_name": f"concat({TWO}, ' JR')", "suffix": NULL}, {"last_name": TWO, "suffix": "'JR'"}),
    "M-NAME-08b": ("none", NO_ID | {"middle_name": "'JR'", "suffix": NULL}, {"middle_name": NULL, "suffix": "'JR'"} | MOVE_NEAR), "M-NAME-09": ("none", NO_ID | {"first_name": pick(list(NICKNAMES), "d")}, {"first_name": NICK}), "M-NAME-10": ("none", NO_ID, {"last_name": typo("last_name")}),
    "M-NAME-11": ("none", NO_ID, {"first_name": typo("first_name")}), "M-NAME-12": ("none", NO_ID, {"last_name": typo("last_name")}), "M-NAME-17": ("none", NO_ID | {"middle_name": "'A'"}, {"middle_name": "'B'"} | MOVE_NEAR), "M-NAME-13": ("none", NO_ID, {"first_name": "substr(first_name, 1, 1)"}),
    "M-NAME-14": ("none", NO_ID | LONG_NAME, {"last_name": "'VILLARR'"}), "M-NAME-16": ("none", NO_ID | {"last_name": "'DE LA CRUZ'"}, {"last_name": "'DELACRUZ'"}), "M-ADDR-01": ("none", NO_ID | {"address2": "'APT 7'"}, {"address2": NULL, "address": typo("address")}),
    "M-ADDR-02": ("none", NO_ID | {"address2": "'APT 7'"}, {"address2": "'APT 9'", "address": typo("address")}), "M-ADDR-03": ("none", NO_ID | {"address2": "'APT 7'"}, {"address": "concat(address, ' APT 7')", "address2": NULL}), "M-ADDR-04": ("none", NO_ID, {"address": typo("address")}),
    "M-ADDR-05": ("none", NO_ID, {"address": "concat('9', s_address)"}), "M-ADDR-06": ("none", NO_ID | {"address": "'12 N MAIN ST'"}, {"address": "'12 NORTH MAIN STREET'"}), "M-ZIP-01": ("none", NO_ID, MOVE_NEAR), "M-DOB-02": ("full", {}, {"dob": SWAP_DAY}),
    "M-DOB-03": ("full", {}, {"dob": "cast(add_months(cast(dob as date), CASE WHEN d < 0.5 THEN 12 ELSE -12 END) as string)"}), "M-DOB-04": ("full", {}, {"dob": shift_days(1)}), "M-DOB-05": ("full", {}, {"dob": NULL}),
    "M-PHONE-01": ("none", NO_ID | {"phone": "'3124450001 7734450002'"}, {"phone": "'3124450001 8474450003'"} | MOVE_NEAR), "M-PHONE-02": ("none", NO_ID, OTHER_PHONE | {"address": typo("address")}), "M-EMAIL-01": ("none", NO_ID | WITH_MAIL, {"email": OTHER_MAIL, "address": typo("address")}),
    "M-EMAIL-02": ("none", NO_ID | {"email": "'ME@GMAIL.COM'"}, {"email": "'ME@GMIAL.COM'", "address": typo("address")}), "M-SEX-02": ("none", NO_ID | {"sex": "'OTHER'"}, {"sex": "CASE WHEN d < 0.5 THEN 'FEMALE' ELSE 'MALE' END"} | MOVE_NEAR), "M-PED-01": ("control", NO_ID | CHILD, {}),
    "M-PED-02": ("control", LAST4 | CHILD, {}), "M-PED-03": ("none", NO_ID | CHILD, {"first_name": typo("first_name")}), "M-MIX-01": ("none", LAST4, {"last_name": typo("last_name")} | MOVE), "M-MIX-02": ("none", LAST4, {"last_name": typo("last_name")} | MOVE | OTHER_PHONE),
}

SAME = lambda *fs: {f: f"a_{f}" for f in fs}
HOME = ("address", "address2", "city", "state", "zip")
#: The second record's own value, or another where the first one's is the same by chance.
UNLIKE_FIRST = {"first_name": "CASE WHEN first_name = a_first_name THEN 'OLGA' ELSE first_name END"}
UNLIKE_LAST = {"last_name": "CASE WHEN last_name = a_last_name THEN 'ZAPATA' ELSE last_name END"}


def gap(lo: int, hi: int) -> dict[str, str]:
    return {"dob": f"cast(add_months(cast(a_dob as date), 12 * cast({lo} + floor(d * {hi - lo + 1}) as int) + 1) as string)"}


FAR = {"dob": "cast(add_months(cast(a_dob as date), CASE WHEN d < 0.5 THEN 84 ELSE -108 END) as string)"}
KEYS = ("last_name", "dob", "address", "ssn4", "phone")


def shared(i: int) -> str:
    """Whether a bulk non-match shares key i: one, two or three of the keys, those of the least draws, are shared."""
    return f"{' + '.join(f'cast(k{j} < k{i} as int)' for j in range(len(KEYS)) if j != i)} < CASE WHEN d < 0.58 THEN 1 WHEN d < 0.88 THEN 2 ELSE 3 END"


COMMON = SAME("first_name", "last_name") | FAR | NO_ID
#: Non-matches: changes of the first record, then of the second with a_<field> for the first.
NONMATCHES: dict[str, tuple[str, dict[str, str], dict[str, str]]] = {
    "NM-EASY-01": ("easy", {}, {}), "NM-EASY-02": ("easy", {}, SAME("state")), "NM-HH-TWIN": ("hard", NO_ID, SAME("last_name", "dob", *HOME) | UNLIKE_FIRST | NO_ID), "NM-HH-TRIPLET-LIKE": ("hard", NO_ID, SAME("dob", *HOME) | UNLIKE_LAST | UNLIKE_FIRST | NO_ID),
    "NM-HH-JR-SR": ("hard", NO_ID, SAME("first_name", "last_name", *HOME) | gap(20, 40) | {"suffix": "'JR'"} | NO_ID), "NM-HH-SIBLING": ("hard", NO_ID, SAME("last_name", *HOME) | gap(-10, 10) | UNLIKE_FIRST | NO_ID), "NM-HH-PARENT-CHILD": ("hard", NO_ID, SAME("last_name", *HOME) | gap(15, 40) | UNLIKE_FIRST | NO_ID),
    "NM-HH-SPOUSE": ("hard", NO_ID, SAME("phone", *HOME) | gap(-5, 5) | UNLIKE_LAST | UNLIKE_FIRST | NO_ID), "NM-HH-ROOMMATE": ("hard", NO_ID, SAME(*HOME) | gap(-20, 20) | UNLIKE_LAST | UNLIKE_FIRST | NO_ID), "NM-HH-COUSIN": ("hard", NO_ID, SAME("last_name", "city", "zip") | UNLIKE_FIRST | NO_ID),
    "NM-COMMON-01": ("hard", NO_ID | {"city": "'CHICAGO'"}, COMMON | SAME("city")), "NM-COMMON-02": ("hard", NO_ID | {"city": "'CHICAGO'"}, COMMON | SAME("city", "zip")), "NM-COMMON-03": ("hard", NO_ID | {"last_name": "'GARCIA LOPEZ'"}, COMMON | SAME("city")), "NM-COMMON-04": ("hard", NO_ID | {"zip": "'60629'"}, COMMON | SAME("city", "zip")),
    "NM-COMMON-05": ("hard", NO_ID | {"phone": "'3124450001'"}, COMMON | {"phone": "'3124459999'"}), "NM-COMMON-06": ("hard", NO_ID, SAME("first_name", "last_name") | {"dob": "cast(date_add(cast(a_dob as date), CASE WHEN d < 0.5 THEN 1 ELSE 2 END) as string)"} | NO_ID), "NM-COMMON-07": ("hard", NO_ID, SAME("last_name") | FAR | {"first_name": typo("a_first_name")} | NO_ID),
    "NM-SSN-01": ("hard", LAST4, SAME("ssn4") | UNLIKE_FIRST | UNLIKE_LAST | LAST4), "NM-SSN-02": ("hard", LAST4, SAME("ssn4") | {"first_name": "concat(substr(a_first_name, 1, 1), 'ENOX')"} | UNLIKE_LAST | LAST4), "NM-SSN-03": ("hard", {}, SAME("ssn", "ssn4") | UNLIKE_FIRST | UNLIKE_LAST),
    "NM-SSN-04": ("hard", {"sex": "'FEMALE'"}, SAME("ssn", "ssn4") | {"sex": "'MALE'"} | UNLIKE_FIRST | UNLIKE_LAST), "NM-SSN-05": ("hard", {}, {"ssn": NULL, "ssn4": "CASE WHEN a_ssn4 = '1234' THEN '4321' ELSE '1234' END"} | SAME("last_name") | UNLIKE_FIRST), "NM-SSN-06": ("hard", LAST4, SAME("ssn4", "dob") | UNLIKE_FIRST | UNLIKE_LAST | LAST4),
    "NM-IDF-01": ("hard", NO_ID | {"address": "'100 SHELTER WAY'"}, SAME(*HOME) | UNLIKE_FIRST | NO_ID), "NM-IDF-02": ("hard", NO_ID, SAME("phone") | UNLIKE_FIRST | NO_ID), "NM-IDF-03": ("hard", NO_ID | {"email": "'FAMILY@GMAIL.COM'"}, SAME("email") | UNLIKE_FIRST | NO_ID), "NM-IDF-04": ("hard", NO_ID, SAME("phone", *HOME) | UNLIKE_FIRST | NO_ID),
    "NM-IDF-05": ("hard", NO_ID | {"email": "'A1@GMAIL.COM'"}, SAME("last_name") | {"email": "'B2@GMAIL.COM'"} | UNLIKE_FIRST | NO_ID), "NM-PED-01": ("hard", NO_ID | CHILD, SAME("last_name", "phone", *HOME) | UNLIKE_FIRST | NO_ID), "NM-PED-02": ("hard", NO_ID | CHILD, SAME("dob", *HOME) | UNLIKE_FIRST | NO_ID),
    "NM-BND-01": ("hard", NO_ID | THIN, THIN | NO_ID | SAME("dob") | UNLIKE_FIRST | UNLIKE_LAST), "NM-BND-02": ("hard", NO_ID | THIN, THIN | NO_ID | SAME("first_name", "last_name") | {"dob": "cast(add_months(cast(a_dob as date), -96) as string)"}),
    "NM-HARD": ("bulk", LAST4, LAST4 | {f: f"CASE WHEN {shared(i)} THEN a_{f} ELSE {f} END" for i, key in enumerate(KEYS) for f in (HOME if key == "address" else (key,))} | UNLIKE_FIRST),
}


def _by_case(field: str, changes: dict[str, dict[str, str]], plain: str) -> str:
    hits = [f"WHEN case_type = '{c}' THEN {x[field]}" for c, x in changes.items() if field in x]
    return f"CASE {' '.join(hits)} ELSE {plain} END" if hits else plain


def _cases(table: dict, bands: tuple[str, ...]) -> list[str]:
    return [c for c, (band, _, _) in table.items() if band in bands]


def _choose(cases: list[str], at: str) -> str:
    return f"element_at(array({', '.join(repr(c) for c in cases)}), 1 + cast(floor({at} * {len(cases)}) as int))"


def _records(df: DataFrame, eid: str, seed: int, prefix: str) -> DataFrame:
    return df.withColumns({f"{prefix}{f}": F.expr(x) for f, x in entity(eid, seed).items()})


def drifted(df: DataFrame, key: str, seed: int, only: str = "true") -> DataFrame:
    """Each field changed, independently, as often as it differs between records of one entity.

    ``df`` has the fields and those of a spare entity as s_<field>; ``key``: SQL of what
    the draws go by; ``only``: SQL of the rows that drift.
    """
    initial = {n[0]: n for n in sorted(MEN + WOMEN, reverse=True)}
    expanded = "CASE middle_name " + " ".join(f"WHEN '{i}' THEN '{n}'" for i, n in initial.items()) + " ELSE middle_name END"
    surname = f"CASE WHEN w < 0.45 AND NOT sex <=> 'MALE' THEN s_last_name WHEN w < 0.6 AND last_name LIKE '% %' THEN {TWO} ELSE {typo('last_name')} END"
    unit = "CASE WHEN address2 = 'APT 7' THEN 'APT 9' ELSE 'APT 7' END"
    mail = f"CASE WHEN w < 0.15 AND email LIKE '%GMAIL.COM' THEN replace(email, 'GMAIL.COM', 'GMIAL.COM') ELSE {OTHER_MAIL} END"
    steps: list[tuple[str, float, str, dict[str, str]]] = [
        ("last_name", DIFFER_RATES["last_name"], "true", {"last_name": surname}),
        ("first_name", DIFFER_RATES["first_name"], "true", {"first_name": f"CASE WHEN w < 0.4 THEN {NICK} ELSE {typo('first_name')} END"}),
        ("middle", DIFFER_RATES["middle_change"], "middle_name IS NOT NULL", {"middle_name": f"CASE WHEN length(middle_name) > 1 THEN substr(middle_name, 1, 1) ELSE {expanded} END"}),
        ("no_middle", DIFFER_RATES["middle_one_missing"], "true", {"middle_name": NULL}),
        ("dob", DIFFER_RATES["dob"], "dob IS NOT NULL", {"dob": DRIFT}),
        ("move", DIFFER_RATES["address_move"], "true", MOVE),
        ("unit", 0.2, f"{u('drift-move', key, seed)} >= {DIFFER_RATES['address_move']} AND address2 IS NOT NULL", {"address2": unit}),
        ("phone", DIFFER_RATES["phone_no_overlap"], "true", OTHER_PHONE),
        ("email", DIFFER_RATES["email"], "email IS NOT NULL", {"email": mail}),
        ("sex", DIFFER_RATES["sex"], "sex IS NOT NULL", {"sex": "CASE WHEN sex = 'MALE' THEN 'FEMALE' ELSE 'MALE' END"}),
    ]
    names, held = df.columns, "d" in df.columns
    out = df.withColumnRenamed("d", "__d") if held else df
    for name, rate, where, change in steps:
        out = out.withColumns({"d": F.expr(u(f"drift-{name}-d", key, seed)), "w": F.expr(u(f"drift-{name}-w", key, seed))})
        hit = f"({only}) AND ({where}) AND {u(f'drift-{name}', key, seed)} < {rate}"
        out = out.withColumns({f: F.expr(f"CASE WHEN {hit} THEN {x} ELSE {f} END") for f, x in change.items()})
    out = out.drop("d", "w")
    return out.withColumnRenamed("__d", "d").select(*names) if held else out.select(*names)


def entity_records(spark: SparkSession, n: int, seed: int, first: int = 0, full: float = 0.21, last4: float = 0.2) -> DataFrame:
    """PATID, entity_id and fields of one to five records of each of n entities: the first as it is, the others drifted."""
    r = lambda s: u(s, "eid", seed)
    df = _records(_records(spark.range(first, first + n).selectExpr("id AS eid"), "eid", seed, ""), "concat('spare', eid)", seed, "s_")
    df = df.withColumns({"ssn": F.expr(f"CASE WHEN {r('has_id')} < {full} THEN ssn END"), "ssn4": F.expr(f"CASE WHEN {r('has_id')} < {full + last4} THEN ssn4 END")})
    many = F.lit(1)
    for band, shares in RECORDS_OF.items():
        at, upto = F.expr(r("records")), 0.0
        for share in shares[:-1]:
            upto += share
            many = many + F.when((band_of(F.col("ssn"), F.col("ssn4")) == band) & (at >= upto), 1).otherwise(0)
    df = df.withColumn("k", F.explode(F.sequence(F.lit(1), many)))
    out = drifted(df, "concat(eid, '-', k)", seed, "k > 1")
    return out.select(F.expr("concat('E', eid, 'R', k)").alias("PATID"), F.col("eid").alias("entity_id"), *FEATURES)


def held_out(entity: Column, seed: int, share: float = 0.15) -> Column:
    """Whether an entity is one of the test's: by a hash, so that no entity is on both sides."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), entity.cast("string"))), 1, 8), 16, 10).cast("double") / float(1 << 32) < share


def enforce_band(pairs: DataFrame, band: Column, seed: int) -> DataFrame:
    """Matches with identifiers as their band has them: "easy" full numbers on both sides, "last4" the last four only, else none that match.

    In the last, three quarters of the records have none and an eighth or so the last four
    alone; an address that both have is drawn anew for 85 of 100; and no pair stays equal in
    name, date and address.
    """
    draw_of = lambda s: F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(f"{seed}:{s}"), "PATID_A", "PATID_B")), 1, 8), 16, 10).cast("double") / float(1 << 32)
    spare = F.concat(F.lit("7"), F.lpad(F.floor(draw_of("ssn") * 90_000_000).cast("string"), 8, "1"))
    ssn = F.coalesce("ssn_l", "ssn_r", spare)
    tail = F.coalesce("ssn4_l", "ssn4_r", F.right(spare, F.lit(4)))
    easy, last4, hard = band == "easy", band == "last4", ~band.isin("easy", "last4")
    cols = {}
    for s in ("l", "r"):
        t = draw_of(f"strip-{s}")
        cols[f"ssn_{s}"] = F.when(easy, ssn).when(last4 | (t < 0.9), F.lit(None).cast("string")).otherwise(F.col(f"ssn_{s}"))
        cols[f"ssn4_{s}"] = F.when(easy, F.right(ssn, F.lit(4))).when(last4, tail).when(t < 0.75, F.lit(None).cast("string")).otherwise(F.col(f"ssn4_{s}"))
    out = pairs.withColumns(cols)
    alike = lambda f: hard & F.coalesce(F.col(f"{f}_l") == F.col(f"{f}_r"), F.lit(False))
    moved = F.concat(F.lit("9"), F.col("address_r"))
    out = out.withColumns({"ssn_r": F.when(alike("ssn"), F.lit(None).cast("string")).otherwise(F.col("ssn_r")), "ssn4_r": F.when(alike("ssn4"), F.lit(None).cast("string")).otherwise(F.col("ssn4_r")), "address_r": F.when(alike("address") & (draw_of("move") < 0.85), moved).otherwise(F.col("address_r"))})
    equal = F.lit(True)
    for f in ("first_name", "last_name", "dob", "address"):
        equal = equal & F.col(f"{f}_l").eqNullSafe(F.col(f"{f}_r"))
    return out.withColumn("last_name_r", F.when(equal, F.concat(F.coalesce("last_name_r", F.lit("")), F.lit("Z"))).otherwise(F.col("last_name_r")))


def build_pools(records: DataFrame, fields: tuple[str, ...] = ("first_name", "last_name"), k: int = 20, top: int = 100) -> dict[str, dict[str, list]]:
    """Weighted heads of real values that at least k records have, with the curated names as tail; and street stems.

    What cleaning takes for no name, suffixes and numbers are left out. The result is of bounded size.
    """
    tails = {"first_name": sorted(set(MEN + WOMEN)), "last_name": sorted(set(SURNAMES))}
    out: dict[str, dict[str, list]] = {}
    for f in fields:
        head = records.where(F.col(f).isNotNull() & ~filtered_token(f)).groupBy(F.col(f).alias("v")).agg(F.count("*").alias("n")).where(F.col("n") >= k)
        out[f] = {"weighted_head": [[r["v"], r["n"]] for r in head.orderBy(F.desc("n"), "v").limit(top).collect()], "tail": tails.get(f, [])}
    word = F.element_at(F.split(F.trim("address"), " "), -1)
    kind = word.isin(*KINDS)
    stem = F.when(kind & (F.size(F.split(F.trim("address"), " ")) > 1), F.element_at(F.split(F.trim("address"), " "), -2)).otherwise(word)
    stems = records.where(F.col("address").isNotNull()).select(stem.alias("v")).where(~F.col("v").rlike("^[0-9]+$")).groupBy("v").agg(F.count("*").alias("n")).where(F.col("n") >= k)
    out["street"] = {"names": sorted({r["v"] for r in stems.orderBy(F.desc("n"), "v").limit(top).collect()} | set(STREETS))}
    return out


def _finish(df: DataFrame, label: int) -> DataFrame:
    changed = F.to_json(F.filter(F.array(*[F.when(~F.col(f"{f}_l").eqNullSafe(F.col(f"{f}_r")), f) for f in FEATURES]), lambda x: x.isNotNull()))
    out = df.withColumn("label", F.lit(label)).withColumn("corruptions_applied", changed if label else F.lit("[]"))
    return out.select("PATID_A", "PATID_B", *[f"{f}_{s}" for f in FEATURES for s in ("l", "r")], "label", "case_type", "corruptions_applied", "entity_id_a", "entity_id_b")


def matches(spark: SparkSession, n: int, seed: int, first: int = 0, bands: tuple[float, float, float] = (0.05, 0.15, 0.02), cases: list[str] | None = None) -> DataFrame:
    """n matches from entity ``first`` on. bands: shares with a full number, with the last four only, and of the ambiguous case."""
    full, last4, amb = bands
    r = lambda s: u(s, "eid", seed)
    case = _choose(cases, r("case")) if cases else f"CASE WHEN {r('band')} < {full} THEN {_choose(_cases(MATCHES, ('full',)), r('case'))} WHEN {r('band')} < {full + last4} THEN {_choose(_cases(MATCHES, ('last4',)), r('case'))} WHEN {r('band')} < {full + last4 + amb} THEN 'POL-AMBIG-03' ELSE {_choose(_cases(MATCHES, ('none',)), r('case'))} END"
    df = spark.range(first, first + n).selectExpr("id AS eid").withColumn("case_type", F.expr(case)).withColumn("d", F.expr(r("draw")))
    df = _records(_records(df, "eid", seed, ""), "concat('spare', eid)", seed, "s_")
    df = df.withColumns({f: F.expr(_by_case(f, {c: x[1] for c, x in MATCHES.items()}, f)) for f in FEATURES})
    copy = {f"{f}_r": F.expr(_by_case(f, {c: x[2] for c, x in MATCHES.items()}, f)) for f in FEATURES}
    df = df.withColumns(copy | {f"{f}_l": F.col(f) for f in FEATURES})
    # people without a number move often: few of their pairs have one address
    unnumbered = ", ".join(repr(c) for c in _cases(MATCHES, ("none",)))
    df = df.withColumn("address_r", F.expr(f"CASE WHEN case_type IN ({unnumbered}) AND address_r = address_l AND {r('mobile')} < 0.85 THEN s_address ELSE address_r END"))
    ids = {"PATID_A": F.expr("concat('E', eid, 'A')"), "PATID_B": F.expr("concat('E', eid, 'B')"), "entity_id_a": F.col("eid"), "entity_id_b": F.col("eid")}
    return _finish(df.withColumns(ids), 1)


def nonmatches(spark: SparkSession, n: int, seed: int, first: int, easy: float = 0.03, named: float = 0.5, cases: list[str] | None = None) -> DataFrame:
    """n non-matches of entities ``first``, ``first`` + 1, ...; shares of easy cases and of the named hard ones, the rest forced."""
    r = lambda s: u(s, "eid", seed)
    case = _choose(cases, r("case")) if cases else f"CASE WHEN {r('band')} < {easy} THEN {_choose(_cases(NONMATCHES, ('easy',)), r('case'))} WHEN {r('band')} < {easy + named} THEN {_choose(_cases(NONMATCHES, ('hard',)), r('case'))} ELSE 'NM-HARD' END"
    df = spark.range(0, n).selectExpr(f"{first} + 2 * id AS eid").withColumn("case_type", F.expr(case)).withColumn("d", F.expr(r("draw"))).withColumns({f"k{i}": F.expr(r(f"key{i}")) for i in range(len(KEYS))})
    spare = [f"s_{f}" for f in FEATURES]
    bulk = "case_type = 'NM-HARD'"
    df = drifted(_records(_records(df, "eid", seed, ""), "concat('spare', eid)", seed, "s_"), "eid", seed, bulk).drop(*spare)
    df = df.withColumns({f: F.expr(_by_case(f, {c: x[1] for c, x in NONMATCHES.items()}, f)) for f in FEATURES}).withColumnsRenamed({f: f"a_{f}" for f in FEATURES})
    df = drifted(_records(_records(df, "(eid + 1)", seed, ""), "concat('spare', eid + 1)", seed, "s_"), "(eid + 1)", seed, bulk).drop(*spare)
    df = df.withColumns({f"{f}_r": F.expr(_by_case(f, {c: x[2] for c, x in NONMATCHES.items()}, f)) for f in FEATURES} | {f"{f}_l": F.col(f"a_{f}") for f in FEATURES})
    # no two entities may agree on first and last name, date and address at once
    same = " AND ".join(f"{f}_l <=> {f}_r" for f in ("first_name", "last_name", "dob", "address"))
    df = df.withColumn("first_name_r", F.expr(f"CASE WHEN {same} THEN concat(first_name_r, 'A') ELSE first_name_r END"))
    keys = F.concat_ws("+", *[F.when(F.col(f"{f}_l") == F.col(f"{f}_r"), f.upper()) for f in KEYS])
    df = df.withColumn("case_type", F.when(F.col("case_type") == "NM-HARD", F.concat_ws("-", F.lit("NM-HARD"), keys)).otherwise(F.col("case_type")))
    ids = {"PATID_A": F.expr("concat('E', eid)"), "PATID_B": F.expr("concat('E', eid + 1)"), "entity_id_a": F.col("eid"), "entity_id_b": F.col("eid") + 1}
    return _finish(df.withColumns(ids), 0)


def build(spark: SparkSession, n: int, prevalence: float, seed: int, first: int = 0, easy: float = 0.03) -> DataFrame:
    """n pairs of which ``prevalence`` are matches; the order is by md5, at the sink, if one is wanted."""
    pos = round(n * prevalence)
    return matches(spark, pos, seed, first).unionByName(nonmatches(spark, n - pos, seed, first + pos, easy))


def build_train(spark: SparkSession, n: int = 40_000, seed: int = 42) -> DataFrame:
    return build(spark, n, 0.4, seed)


def build_test(spark: SparkSession, n: int = 10_000, prevalence: float = 0.2, seed: int = 43, first: int = 10_000_000) -> DataFrame:
    return build(spark, n, prevalence, seed, first, easy=0.0)


def technical(pairs: DataFrame) -> DataFrame:
    """Canonical to technical column names of both sides."""
    return pairs.withColumnsRenamed({f"{name}_{s}": f"{src}_{s}" for src, name in RENAMES.items() for s in ("l", "r")})


def records_of(pairs: DataFrame) -> DataFrame:
    """Every record of a pair corpus once."""
    side = lambda s, at: pairs.select(F.col(at).alias("PATID"), *[F.col(f"{f}_{s}").alias(f) for f in FEATURES])
    return side("l", "PATID_A").unionByName(side("r", "PATID_B")).dropDuplicates(["PATID"])
