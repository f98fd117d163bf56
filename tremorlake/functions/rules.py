"""Grading rules of vibration monitoring as column expressions over one row a machine or frame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: Zone limits A/B, B/C, C/D in mm/s by machine group and support, and by pump category and power.
MACHINE_LIMITS = {
    ("group1", "rigid"): (2.3, 4.5, 7.1),
    ("group1", "flexible"): (3.5, 7.1, 11.0),
    ("group2", "rigid"): (1.4, 2.8, 4.5),
    ("group2", "flexible"): (2.3, 4.5, 7.1),
}
PUMP_LIMITS = {
    ("category1", "le200"): (2.5, 4.0, 6.6),
    ("category1", "gt200"): (3.5, 5.0, 7.6),
    ("category2", "le200"): (3.2, 5.1, 8.5),
    ("category2", "gt200"): (4.2, 6.1, 9.5),
}
SMALL_MACHINE_LIMITS = (0.71, 1.8, 4.5)
#: Equipment classes with their types, and those no standard here covers with whether another one does.
CLASSES = {
    "EM": ("AC", "DC"), "EG": ("TD", "SD", "TE", "MD"), "BL": ("rotaryPD",), "CO": ("CE", "RE", "SC", "AX", "rotaryPD"), "GT": ("IN", "AD", "HD"),
    "ST": ("MS", "SS"), "PU": ("CE", "RE", "RO"), "CE": ("DE", "GE"), "CF": (), "TE": ("CE", "AX"), "LE": (), "MI": (),
    "windTurbine": (), "hydroUnit": (), "other": (), "servoMotor": ("AC", "DC"),
}
NOT_COVERED = {
    ("CE", ""): True, ("CO", "RE"): True, ("CO", "SC"): True, ("CO", "rotaryPD"): True, ("BL", "rotaryPD"): True, ("PU", "RE"): True,
    ("PU", "RO"): False, ("EG", "MD"): True, ("CF", ""): True, ("TE", ""): False, ("LE", ""): False, ("MI", ""): False,
    ("windTurbine", ""): True, ("hydroUnit", ""): True, ("other", ""): False,
}
ELECTRICAL = ("EM", "EG", "servoMotor")
PUMPS = ("category1", "category2")
#: Powers in kW, speeds in r/min, shaft heights in mm.
MACHINE_KW, MACHINE_RPM, PUMP_MIN_KW, PUMP_SPLIT_KW = (15.0, 50000.0), (120.0, 15000.0), 1.0, 200.0
GAS_TURBINE_MAX_KW, FAN_SPLIT_KW, GROUP1_KW, SHAFT_GROUP1, SHAFT_GROUP2 = 3000.0, 300.0, 300.0, 315.0, 160.0
LOW_SPEED_RPM = 600.0
RANKS = ("normal", "attention", "warning", "danger")
#: Least scale of each quantity, IQR to standard deviation, notable z, axial share, balance.
LEAST_SCALE = {"vel": 0.01, "acc": 0.01, "disp": 1.0, "freq": 1.0, "temp": 0.01}
IQR_TO_SIGMA, NOTABLE_Z, AXIAL_SHARE, BALANCED = 1.349, 3.0, 0.5, 0.8


# The rules of machines are written as SQL text, one expression a rule: a plan of many small column objects takes seconds to build.


def _t(name: str) -> str:
    """A text setting without blanks around it, empty where missing."""
    return f"trim(coalesce({name}, ''))"


def _pos(name: str) -> str:
    """A number setting, null unless positive and finite."""
    v = f"try_cast({_t(name)} AS DOUBLE)"
    return f"CASE WHEN {v} > 0 AND {v} < double('infinity') THEN {v} END"


def _in(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


def _limits(values: tuple) -> str:
    return "array(" + ", ".join(f"{v}D" for v in values) + ")"


def positive(name: str) -> Column:
    return F.expr(_pos(name))


def _first(pairs: list[tuple[Column, Column]], otherwise: Column) -> Column:
    out = F.when(F.lit(False), otherwise)
    for when, then in pairs:
        out = out.when(F.coalesce(when, F.lit(False)), then)
    return out.otherwise(otherwise)


_CLS, _KIND = _t("equipmentClass"), _t("equipmentType")
#: Null if a standard may cover class and type, else whether another standard does; the exact pair first.
_EXCLUDED = (
    "CASE "
    + " ".join(f"WHEN {_CLS} = '{c}' AND {_KIND} = '{k}' THEN {v}" for (c, k), v in NOT_COVERED.items() if k)
    + " "
    + " ".join(f"WHEN {_CLS} = '{c}' THEN {v}" for (c, k), v in NOT_COVERED.items() if not k)
    + " END"
)
_PUMP = f"({_CLS} = 'PU' OR ({_CLS} = '' AND {_t('pumpCategory')} IN {_in(PUMPS)}))"
_SHAFT = f"CASE WHEN {_CLS} IN {_in(ELECTRICAL)} THEN {_pos('shaftHeightMm')} END"
_GROUP = f"CASE WHEN ({_SHAFT}) >= {SHAFT_GROUP1} THEN 'group1' WHEN ({_SHAFT}) >= {SHAFT_GROUP2} THEN 'group2' WHEN ({_pos('ratedPowerKw')}) > {GROUP1_KW} THEN 'group1' WHEN ({_pos('ratedPowerKw')}) IS NOT NULL THEN 'group2' END"


def _partners(classes: str, types: str) -> str:
    """array<struct<c, k>> of coupled machines by position; empty if none or if the counts differ."""
    c = f"transform(split({_t(classes)}, ','), x -> trim(x))"
    k = f"CASE WHEN {_t(types)} = '' THEN transform({c}, x -> '') ELSE transform(split({_t(types)}, ','), x -> trim(x)) END"
    none = "CAST(array() AS array<struct<c:string,k:string>>)"
    return f"CASE WHEN {_t(classes)} <> '' AND size({c}) = size({k}) THEN zip_with({c}, {k}, (a, b) -> struct(a AS c, b AS k)) ELSE {none} END"


_RECIPROCATING = "x -> x.c = 'CE' OR (x.c = 'CO' AND x.k = 'RE') OR (x.c = 'PU' AND x.k = 'RE')"
_DRIVER = _partners("driverClass", "driverType")
#: Whether a coupled machine is a reciprocating one; for a pump only its driver counts, and only engines.
_COUPLED = f"CASE WHEN {_PUMP} THEN exists({_DRIVER}, x -> x.c = 'CE') ELSE exists({_DRIVER}, {_RECIPROCATING}) OR exists({_partners('drivenClass', 'drivenType')}, {_RECIPROCATING}) END"


def excluded() -> Column:
    return F.expr(_EXCLUDED)


def machine_group() -> Column:
    """group1 or group2: electrical machines by shaft height from 160 mm on, else by rated power; null if neither is known."""
    return F.expr(_GROUP)


def group_basis() -> Column:
    return F.expr(f"CASE WHEN ({_SHAFT}) >= {SHAFT_GROUP2} THEN 'shaftHeight' WHEN ({_pos('ratedPowerKw')}) IS NOT NULL THEN 'ratedPower' END")


def grading_reason() -> Column:
    """Why no standard grades the machine, null if one does; reasons that begin with no_standard are of scope."""
    category, support, kw, rpm = _t("pumpCategory"), _t("supportClass"), f"({_pos('ratedPowerKw')})", f"({_pos('ratedSpeedRpm')})"
    wrong = " OR ".join(f"({_CLS} = '{c}'" + (f" AND {_KIND} NOT IN {_in(ks)})" if ks else ")") for c, ks in CLASSES.items())
    scope = lambda why: f"'no_standard: {why}'"
    steps = [
        (f"{_KIND} <> '' AND {_CLS} = ''", "'type without class'"),
        (f"{_KIND} <> '' AND ({wrong})", "'unknown type'"),
        (f"{category} IN {_in(PUMPS)} AND {_CLS} NOT IN ('', 'PU')", "'pump category of another class'"),
        (f"lower({_t('vel_is_rms')}) <> 'true'", "'velocity is not RMS'"),
        (f"{_CLS} <> '' AND {_CLS} NOT IN {_in(CLASSES)}", scope("class")),
        (f"({_EXCLUDED}) IS NOT NULL", scope("excluded")),
        (_COUPLED, scope("coupled to a reciprocating machine")),
        (f"{_PUMP} AND {_t('pumpEnvironment')} = 'submerged'", scope("submerged pump")),
        (f"{_PUMP} AND {category} NOT IN {_in(PUMPS)}", "'pump category missing'"),
        (f"{_PUMP} AND {kw} IS NULL", "'pump power missing'"),
        (f"{_PUMP} AND {kw} <= {PUMP_MIN_KW}", scope("pump power")),
        (_PUMP, "CAST(NULL AS STRING)"),
        (f"{_CLS} = 'GT' AND {kw} > {GAS_TURBINE_MAX_KW}", scope("large gas turbine")),
        (f"{_CLS} = 'BL' AND {support} = 'flexible' AND {kw} <= {FAN_SPLIT_KW}", scope("flexible fan")),
        (f"{kw} <= {MACHINE_KW[0]} OR {kw} > {MACHINE_KW[1]}", scope("power")),
        (f"{rpm} < {MACHINE_RPM[0]} OR {rpm} > {MACHINE_RPM[1]}", scope("speed")),
        (f"({_GROUP}) IS NULL", "'group unknown'"),
        (f"{support} NOT IN ('rigid', 'flexible')", "'support missing'"),
    ]
    return F.expr("CASE " + " ".join(f"WHEN {when} THEN {then}" for when, then in steps) + " END")


def standard_limits() -> Column:
    """Limits of the standard that applies; to be used where grading_reason is null."""
    band = f"CASE WHEN ({_pos('ratedPowerKw')}) <= {PUMP_SPLIT_KW} THEN 'le200' ELSE 'gt200' END"
    of = lambda table, a, b: "CASE " + " ".join(f"WHEN {a} = '{x}' AND {b} = '{y}' THEN {_limits(v)}" for (x, y), v in table.items()) + " END"
    return F.expr(f"CASE WHEN {_PUMP} THEN {of(PUMP_LIMITS, _t('pumpCategory'), f'({band})')} ELSE {of(MACHINE_LIMITS, f'({_GROUP})', _t('supportClass'))} END")


def custom_limits() -> Column:
    """The user's three lines if all are given and rise, else null."""
    a, b, c = (f"try_cast({_t(n)} AS DOUBLE)" for n in ("limitAttention", "limitWarning", "limitDanger"))
    return F.expr(f"CASE WHEN {a} > 0 AND {a} < {b} AND {b} < {c} THEN array({a}, {b}, {c}) END")


def any_custom() -> Column:
    return F.expr(f"concat({_t('limitAttention')}, {_t('limitWarning')}, {_t('limitDanger')}) <> ''")


def small_machine_applies() -> Column:
    ok = f"({_pos('ratedPowerKw')}) <= {MACHINE_KW[0]} AND {_CLS} IN {_in(['', *CLASSES])} AND {_CLS} <> 'BL' AND NOT coalesce({_EXCLUDED}, false) AND NOT {_COUPLED}"
    return F.expr(f"coalesce({ok}, false)")


def severity_zone(v: Column, limits: Column) -> Column:
    """Zone A to D; a limit belongs to the better zone."""
    return F.when(v <= limits[0], "A").when(v <= limits[1], "B").when(v <= limits[2], "C").when(v.isNotNull() & limits.isNotNull(), "D")


def zone_margin(v: Column, limits: Column) -> Column:
    """Distance to the next limit, negative in D."""
    return F.when(v <= limits[0], limits[0] - v).when(v <= limits[1], limits[1] - v).otherwise(limits[2] - v)


def zone_status(zone: Column, custom: Column) -> Column:
    """Status of a zone; B is attention only under limits of the user's own."""
    return F.when(zone == "A", "normal").when(zone == "B", F.when(custom, "attention").otherwise("normal")).when(zone == "C", "warning").when(zone == "D", "danger")


def with_basis(machines: DataFrame) -> DataFrame:
    """machines (with grading_reason) with limits, source and basis_reason: the standard, else the user's lines, else those of small machines.

    Lines that are given but wrong do not fall back. What several rules need is made a column first, so that no rule repeats it.
    """
    why = F.col("grading_reason")
    made = machines.select("*", custom_limits().alias("_custom"), any_custom().alias("_any"), small_machine_applies().alias("_small"), standard_limits().alias("_standard"), why.startswith("no_standard").alias("_scope"))
    source = F.when(why.isNull(), "standard").when(F.col("_scope") & F.col("_custom").isNotNull(), "custom").when(F.col("_scope") & ~F.col("_any") & F.col("_small"), "small_machine")
    made = made.withColumn("source", source)
    limits = F.when(F.col("source") == "standard", F.col("_standard")).when(F.col("source") == "custom", F.col("_custom")).when(F.col("source") == "small_machine", F.array(*map(F.lit, SMALL_MACHINE_LIMITS)))
    reason = F.when(F.col("source").isNull(), F.when(F.col("_scope") & F.col("_any"), "custom lines wrong").otherwise(why))
    return made.withColumn("limits", limits).withColumn("basis_reason", reason).drop("_custom", "_any", "_small", "_standard", "_scope")


def radial_peak(x: Column, y: Column, z: Column, axial: Column) -> Column:
    """The peak that is graded: of the axes but the axial one, of all if that is unknown; null if only the axial one has readings."""
    axial = F.lower(F.trim(F.coalesce(axial, F.lit(""))))
    skip = lambda v, name: F.when((axial != name), v)
    return F.greatest(skip(x, "x"), skip(y, "y"), skip(z, "z"))


def run_state(peak: Column, threshold: Column) -> Column:
    """unjudged without a threshold, config_incomplete for one that is not positive, else stopped or running."""
    t = F.trim(F.coalesce(threshold, F.lit("")))
    v = t.try_cast("double")
    return F.when(t == "", "unjudged").when(F.coalesce(~(v > 0), F.lit(True)), "config_incomplete").when(peak < v, "stopped").when(peak.isNotNull(), "running").otherwise("no_input")


def _radials(x: Column, y: Column, z: Column, axial: Column) -> tuple[Column, Column, Column]:
    pick = lambda a, b, c: F.when(axial == "x", a).when(axial == "y", b).when(axial == "z", c)
    return pick(x, y, z), pick(y, x, x), pick(z, z, y)


def axial_ratio(x: Column, y: Column, z: Column, axial: Column, still: float | None = 0.0) -> Column:
    """Axial over largest radial peak; still where the radial peaks are 0."""
    a, r1, r2 = _radials(x, y, z, axial)
    top = F.greatest(r1, r2)
    return F.when(a.isNotNull() & (top <= 0), F.lit(still).cast("double")).otherwise(a / F.when(top > 0, top))


def direction_hint(x: Column, y: Column, z: Column, axial: Column) -> Column:
    """loose where all axes are balanced, else misaligned where the axial share is high, else unbalanced."""
    a, r1, r2 = _radials(x, y, z, axial)
    ratio, top, low = axial_ratio(x, y, z, axial), F.greatest(r1, r2), F.least(r1, r2)
    both = r1.isNotNull() & r2.isNotNull()
    return (
        F.when(a.isNull() | top.isNull(), None)
        .when(top <= 0, "no radial vibration")
        .when(both & (low / top >= BALANCED) & (ratio >= BALANCED), "loose")
        .when(ratio >= AXIAL_SHARE, "misaligned")
        .otherwise("unbalanced")
    )


def robust_z(v: Column, median: Column, iqr: Column, quantity: str) -> Column:
    return (v - median) / F.greatest(F.coalesce(iqr, F.lit(0.0)) / IQR_TO_SIGMA, F.lit(LEAST_SCALE[quantity]))


def anomaly_score(z: Column, drift: Column, rise: Column) -> Column:
    """0 to 100 from deviation, drift of the axial ratio and temperature rise; missing parts but z count nothing."""
    clip = lambda v: F.least(F.lit(1.0), F.greatest(F.lit(0.0), v))
    part = 0.6 * clip(z / (2 * NOTABLE_Z)) + 0.25 * F.coalesce(clip(F.abs(drift) / 0.5), F.lit(0.0)) + 0.15 * F.coalesce(clip(rise / 10.0), F.lit(0.0))
    return F.when(z.isNotNull(), 100.0 * part)


def rank_of(status: Column) -> Column:
    return _first([(status == s, F.lit(i)) for i, s in enumerate(RANKS)], F.lit(None).cast("int"))


def status_of(rank: Column) -> Column:
    return _first([(rank == i, F.lit(s)) for i, s in enumerate(RANKS)], F.lit(None).cast("string"))


def combine_status(classic: Column, classic_bad: Column, own: Column, own_bad: Column) -> Column:
    """struct<status, quality> of two methods: the highest that is above normal, else the classic method's error, else what is left."""
    top = F.greatest(rank_of(classic), rank_of(own))
    status = F.when(top > 0, status_of(top)).when(classic_bad.isNotNull(), None).when(top.isNotNull(), status_of(top))
    quality = F.when(top > 0, "ok").when(classic_bad.isNotNull(), classic_bad).when(top.isNotNull(), "ok").otherwise(own_bad)
    return F.struct(status.alias("status"), quality.alias("quality"))


def disagreement(classic: Column, own: Column) -> Column:
    return F.when((rank_of(classic) >= 2) & (own == "normal"), "high but unchanged").when((classic == "normal") & (own == "attention"), "early change")


def low_speed_note(speed: Column) -> Column:
    s = F.trim(F.coalesce(speed, F.lit("")))
    v = s.try_cast("double")
    return F.when(s == "", "speed missing").when(v.isNull(), "speed is no number").when(v < LOW_SPEED_RPM, "low speed")


def device_status(statuses: Column) -> Column:
    """The highest status of a collected array, null if none is ranked."""
    ranks = F.transform(statuses, lambda s: rank_of(s))
    return status_of(F.array_max(ranks))


def device_statuses(findings: DataFrame, outputs: DataFrame, by: list[str]) -> DataFrame:
    """(by, status, stopped, modules): of findings (by, domain, key, text, quality) those whose output is a status, one row a device and time.

    status is the highest of the modules that tell one, null if none does; stopped counts those that say stopped, which stands apart and is
    compared with nothing; modules counts all that tell either. outputs: (domain, key, is_status).
    """
    own = findings.join(outputs.where("is_status").select("domain", "key"), ["domain", "key"], "left_semi").where("quality = 'ok' AND text IS NOT NULL")
    rank, still = rank_of(F.col("text")), F.col("text") == "stopped"
    out = own.groupBy(*by).agg(F.max(F.when(~still, rank)).alias("_r"), F.count_if(still).alias("stopped"), F.count_if(still | rank.isNotNull()).alias("modules"))
    return out.select(*by, status_of(F.col("_r")).alias("status"), "stopped", "modules")


#: The settings of which methods run, alarm levels by status, and the slowest beat in s that raises alarms in time.
ALGORITHMS = {"classic": ["classic"], "baseline": ["baseline"], "both": ["classic", "baseline"]}
ALARM_LEVEL = {"attention": 300, "warning": 600, "danger": 800}
SLOW_BEAT_S = 300


def algorithms(setting: Column) -> Column:
    """The methods that a setting enables; null where it is missing or none of ALGORITHMS."""
    s = F.trim(setting)
    return _first([(s == k, F.array(*map(F.lit, v))) for k, v in ALGORITHMS.items()], F.lit(None).cast("array<string>"))


def classify_enabled(setting: Column) -> Column:
    """Whether faults are classified: not where the setting is blank, null where it is neither true nor false."""
    s = F.lower(F.trim(F.coalesce(setting, F.lit(""))))
    return F.when(s == "true", True).when(s.isin("", "false"), False)


def alarm_level(status: Column) -> Column:
    """Level of the alarm row that a status raises; 0 for one that raises none."""
    return _first([(status == k, F.lit(v)) for k, v in ALARM_LEVEL.items()], F.lit(0))
