"""What a diagnosis module declares of itself, and the plans that are built from it.

A declaration is data: checked when a module is made, turned into tables against which all bindings are checked at once, and into a check of
what the module's plan gives before it runs. A module builds DataFrames; rows are never handed to it one by one.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from ..functions import rules
from ..operators import labels
from . import diagnosis

#: Words that declarations may use.
KINDS, AXES = ("point", "image", "struct"), ("", "x", "y", "z")
OUTPUT_TYPES, PARAM_TYPES = ("float", "int", "bool", "string"), ("float", "int", "bool", "string", "enum")
WHEN_STOPPED, STATUS_LEVELS, STOPPED = ("written", "literal", "not_written"), ("normal", "attention", "warning", "danger", "stopped"), "stopped"

#: Columns that a plan must give.
FINDINGS = {"binding": None, "key": "string", "value": "double", "text": "string", "quality": "string", "t": "timestamp"}


@dataclass(frozen=True)
class Input:
    role: str
    kind: str = "point"
    unit: str = ""
    quantity: str = ""
    axis: str = ""
    required: bool = True
    group: str = ""  # all roles of a group are bound, or none
    record: str = ""  # roles of a record come from one point
    struct: str = ""


@dataclass(frozen=True)
class Output:
    key: str
    type: str = "float"
    unit: str = ""
    choices: tuple[str, ...] = ()
    when_stopped: str = "not_written"
    is_status: bool = False
    part: str = ""  # of a module whose parts can be switched off


@dataclass(frozen=True)
class Param:
    key: str
    type: str = "string"
    choices: tuple[str, ...] = ()
    default: str | None = None
    least: float | None = None
    most: float | None = None


@dataclass(frozen=True)
class Declaration:
    inputs: tuple[Input, ...]
    outputs: tuple[Output, ...]
    params: tuple[Param, ...] = ()
    structs: tuple[str, ...] = ()
    stateful: bool = False
    artifacts: tuple[str, ...] = ()

    def problems(self) -> list[str]:
        """All that is wrong with it, not the first only."""
        out = []

        def twice(what: str, names: list) -> None:
            out.extend(f"{what} {n!r} is declared twice" for n, k in Counter(names).items() if k > 1)

        twice("input", [i.role for i in self.inputs])
        twice("output", [o.key for o in self.outputs])
        twice("param", [p.key for p in self.params])
        twice("artifact", list(self.artifacts))
        twice("quantity and axis", [(i.quantity, i.axis) for i in self.inputs if i.quantity])
        out += ["no outputs"] if not self.outputs else []
        out += ["more than one status"] if sum(o.is_status for o in self.outputs) > 1 else []
        for i in self.inputs:
            out += [f"input {i.role}: kind {i.kind!r}"] if i.kind not in KINDS else []
            out += [f"input {i.role}: axis {i.axis!r}"] if i.axis not in AXES else []
            out += [f"input {i.role}: struct {i.struct!r} is not declared"] if i.kind == "struct" and i.struct not in self.structs else []
        for o in self.outputs:
            out += ["output without a key"] if not o.key.strip() else []
            out += [f"output {o.key}: type {o.type!r}"] if o.type not in OUTPUT_TYPES else []
            out += [f"output {o.key}: when stopped {o.when_stopped!r}"] if o.when_stopped not in WHEN_STOPPED else []
            out += [f"output {o.key}: a literal when stopped needs choices"] if o.when_stopped == "literal" and not o.choices else []
            if o.is_status:
                out += [f"output {o.key}: a status is text of {', '.join(STATUS_LEVELS)}"] if o.type != "string" or not o.choices or set(o.choices) - set(STATUS_LEVELS) else []
                out += [f"output {o.key}: {STOPPED} is a choice if and only if it is written when stopped"] if (STOPPED in o.choices) != (o.when_stopped == "literal") else []
        for p in self.params:
            out += [f"param {p.key}: type {p.type!r}"] if p.type not in PARAM_TYPES else []
            out += [f"param {p.key}: choices belong to an enum, and an enum has some"] if (p.type == "enum") != bool(p.choices) else []
            out += [f"param {p.key}: default {p.default!r} is no choice"] if p.choices and p.default and p.default not in p.choices else []
            out += [f"param {p.key}: bounds belong to numbers"] if (p.least is not None or p.most is not None) and p.type not in ("float", "int") else []
            out += [f"param {p.key}: least over most"] if p.least is not None and p.most is not None and p.least > p.most else []
        return out


@dataclass(frozen=True)
class Module:
    """A declaration with the plan of its findings, build(samples, dims); artifacts: those that a binding needs, an array column of its params map."""

    key: str
    declaration: Declaration
    build: Callable[[DataFrame, dict[str, DataFrame]], DataFrame]
    artifacts: Callable[[Column], Column] | None = None
    requires: dict[str, str] = field(default_factory=lambda: {"binding": "", "role": "string", "t": "timestamp", "value": "double", "status_code": "int"})

    def __post_init__(self):
        if found := (["module without a key"] if not self.key.strip() else []) + self.declaration.problems():
            raise ValueError(f"module {self.key!r}: " + "; ".join(found))


def tables(spark: SparkSession, modules: list[Module]) -> dict[str, DataFrame]:
    """What modules declare as small tables: inputs, outputs, params, each with domain."""
    inputs = [(m.key, i.role, i.kind, i.unit, i.quantity, i.axis, i.required, i.group, i.record) for m in modules for i in m.declaration.inputs]
    outputs = [(m.key, o.key, o.type, list(o.choices), o.when_stopped, o.is_status, o.part) for m in modules for o in m.declaration.outputs]
    params = [(m.key, p.key, p.type, list(p.choices), p.least, p.most) for m in modules for p in m.declaration.params]
    return {
        "inputs": spark.createDataFrame(inputs, "domain string, role string, kind string, unit string, quantity string, axis string, required boolean, input_group string, record_group string"),
        "outputs": spark.createDataFrame(outputs, "domain string, key string, type string, choices array<string>, when_stopped string, is_status boolean, part string"),
        "params": spark.createDataFrame(params, "domain string, param string, type string, choices array<string>, least double, most double"),
    }


def _typed(value: Column, kind: Column) -> Column:
    """Whether a text is of a declared type; texts and enums always are."""
    number = value.try_cast("double")
    finite = number.isNotNull() & ~F.isnan(number) & (F.abs(number) < float("inf"))
    return (
        F.when(kind == "float", F.coalesce(finite, F.lit(False)))
        .when(kind == "int", F.coalesce(finite & (number == F.floor(number)), F.lit(False)))
        .when(kind == "bool", F.lower(F.trim(value)).isin("true", "false"))
        .otherwise(True)
    )


def check_params(bindings: DataFrame, params: DataFrame) -> DataFrame:
    """(domain, binding, param, violation) of parameters, each text, that aren't as declared; blank ones count as not given."""
    each = bindings.select("domain", "binding", F.explode("params").alias("param", "value")).where(F.trim(F.coalesce("value", F.lit(""))) != "")
    out = each.join(params, ["domain", "param"], "left")
    number = F.col("value").try_cast("double")
    wrong = (
        F.when(F.col("type").isNull(), "not declared")
        .when(~_typed(F.col("value"), F.col("type")), F.concat(F.lit("no "), "type"))
        .when((F.size("choices") > 0) & ~F.array_contains("choices", F.col("value")), "no choice")
        .when(number < F.col("least"), "under least")
        .when(number > F.col("most"), "over most")
    )
    return out.withColumn("violation", wrong).where("violation IS NOT NULL").select("domain", "binding", "param", "violation")


def half_bound_groups(bindings: DataFrame, inputs: DataFrame) -> DataFrame:
    """(domain, binding, input_group) of groups of which some roles are bound and some are not; bindings have roles, a map."""
    groups = inputs.where("input_group <> ''").groupBy("domain", "input_group").agg(F.collect_set("role").alias("own"))
    out = bindings.select("domain", "binding", F.map_keys("roles").alias("bound")).join(groups, "domain")
    n = F.size(F.array_intersect("own", "bound"))
    return out.where((n > 0) & (n < F.size("own"))).select("domain", "binding", "input_group")


def binding_problems(bindings: DataFrame, declared: dict[str, DataFrame]) -> DataFrame:
    """(domain, binding, problem): all that is wrong with bindings, by their own shape and by what their module declares.

    bindings: (domain, binding, roles map, params map, and what check_bindings reads besides); declared: tables().
    """
    bound = bindings.select("domain", "binding", F.explode(F.map_keys("roles")).alias("role"))
    say = lambda df, *parts: df.select("domain", "binding", F.concat(*parts).alias("problem"))
    images = declared["inputs"].groupBy("domain").agg(F.every(F.col("kind") == "image").alias("image_only"))
    out = say(labels.check_bindings(bindings.join(images, "domain", "left")).withColumn("v", F.explode("violations")), F.col("v"))
    points = declared["inputs"].where("kind <> 'image'")
    out = out.union(say(labels.missing_required_roles(bindings, bound, points), F.lit("role not bound: "), F.col("role")))
    out = out.union(say(labels.undeclared_roles(bound, declared["inputs"]), F.lit("role not declared: "), F.col("role")))
    out = out.union(say(check_params(bindings, declared["params"]), F.col("param"), F.lit(": "), F.col("violation")))
    return out.union(say(half_bound_groups(bindings, declared["inputs"]), F.lit("half a group: "), F.col("input_group")))


def _fit(schema: StructType, wanted: dict[str, str | None], what: str) -> list[str]:
    have = {f.name: f.dataType.simpleString() for f in schema.fields}
    return [f"{what} lacks {c}" for c in wanted if c not in have] + [f"{what}: {c} is {have[c]}, not {t}" for c, t in wanted.items() if t and c in have and have[c] != t]


def plan(module: Module, samples: DataFrame, dims: dict[str, DataFrame]) -> DataFrame:
    """The module's findings with violation, null where they are as declared; columns are checked by analysis, before anything runs."""
    if found := _fit(samples.schema, {c: t or None for c, t in module.requires.items()}, "input"):
        raise ValueError(f"module {module.key}: " + "; ".join(found))
    findings = module.build(samples, dims)
    if found := _fit(findings.schema, FINDINGS, "output"):
        raise ValueError(f"module {module.key}: " + "; ".join(found))
    outputs = tables(samples.sparkSession, [module])["outputs"].select("key", "type", "choices")
    is_text = F.col("type") == "string"
    value = F.when(is_text, F.col("text")).otherwise(F.col("value").cast("string"))
    wrong = (
        F.when(F.col("type").isNull(), "not declared")
        .when((F.col("quality") == "ok") & value.isNull(), "ok without a value")
        .when(F.when(is_text, F.col("value").isNotNull()).otherwise(F.col("text").isNotNull()), F.concat(F.lit("no "), "type"))
        .when(F.col("value").isNotNull() & ~_typed(F.col("value").cast("string"), F.col("type")), F.concat(F.lit("no "), "type"))
        .when((F.size("choices") > 0) & F.col("text").isNotNull() & ~F.array_contains("choices", F.col("text")), "no choice")
    )
    return findings.join(outputs, "key", "left").withColumn("violation", wrong).select(*findings.columns, "violation")


def vibration(window_s: int = 60, stop_below: float | None = None) -> Module:
    """Severity of vibration by window: status, zone, the graded peak and its margin."""
    axes = ("x", "y", "z")
    inputs = [Input(f"{a}_vel", unit="mm/s", quantity="velocity", axis=a, required=a != "z", record="vibration") for a in axes]
    inputs += [Input("x_acc", unit="g", quantity="acceleration", axis="x", required=False), Input("temp", unit="C", quantity="temperature", required=False)]
    outputs = [
        Output("status", "string", choices=STATUS_LEVELS, when_stopped="literal", is_status=True),
        Output("zone", "string", choices=("A", "B", "C", "D", STOPPED), when_stopped="literal", part="classic"),
        Output("vel_radial", unit="mm/s", part="classic"),
        Output("margin", unit="mm/s", part="classic"),
    ]
    params = [
        Param("algorithms"), Param("fault_classify", "bool"), Param("ratedPowerKw", "float", least=0.0), Param("ratedSpeedRpm", "float", least=0.0),
        Param("supportClass", "enum", ("rigid", "flexible")), Param("shaftHeightMm", "float", least=0.0), Param("vel_is_rms", "bool", default="false"),
    ]

    def build(samples: DataFrame, dims: dict[str, DataFrame]) -> DataFrame:
        graded = diagnosis.graded_windows(samples, dims["machines"], window_s)
        if stop_below is not None:
            graded = graded.withColumn("run_state", F.when(F.col("peak") < stop_below, STOPPED).when(F.col("peak").isNotNull(), "running"))
        return diagnosis.to_findings(graded)

    outputs += [Output("run_state", "string", choices=("running", STOPPED), when_stopped="written")] if stop_below is not None else []
    return Module("vibration", Declaration(tuple(inputs), tuple(outputs), tuple(params), artifacts=("baseline", "classifier")), build, vibration_artifacts)


def vibration_artifacts(params: Column) -> Column:
    """baseline where the baseline method is on, classifier unless classification is off; an illegal setting may need either."""
    methods, classify = rules.algorithms(F.try_element_at(params, F.lit("algorithms"))), rules.classify_enabled(F.try_element_at(params, F.lit("fault_classify")))
    needs_baseline = F.coalesce(F.array_contains(methods, "baseline"), F.lit(True))
    return F.array_compact(F.array(F.when(needs_baseline, "baseline"), F.when(F.coalesce(classify, F.lit(True)), "classifier")))


def missing_artifacts(bindings: DataFrame, module: Module, active: DataFrame) -> DataFrame:
    """(binding, kind) of artifacts that bindings (binding, params) need and that are not active, neither their own nor the whole domain's."""
    if module.artifacts is None:
        need = bindings.select("binding", F.explode(F.array(*map(F.lit, module.declaration.artifacts)).cast("array<string>")).alias("kind"))
    else:
        need = bindings.select("binding", F.explode(module.artifacts(F.col("params"))).alias("kind"))
    own = active.where(F.col("domain") == module.key)
    need = need.join(own.where("binding = ''").select("kind").distinct(), "kind", "left_anti")
    return need.join(own.select(F.col("binding").cast(need.schema["binding"].dataType).alias("binding"), "kind"), ["binding", "kind"], "left_anti").select("binding", "kind")
