"""Record extraction with a line-template (Value / state / rule syntax).

The template is read into a ``Template`` (values and rules); ``extract``
turns it into a DataFrame plan over ``(file, line_no, line)``:

* states: every line is a function from the state before it to the state after
  it (the new state of the first rule of that state that matches), and a scan over
  functions gives the state at each line, with a hot file in many tasks.
  Templates of one state need no such scan.  ``End`` and ``EOF`` end a file: no
  rule applies after them, and ``End`` leaves the pending record out;
* rule choice: first rule of the line's state whose pattern matches (``rlike``
  chain).  Rules with ``Continue`` apply and let the line go on to the rules
  below them; such a line becomes one row per rule that applies;
* captures:   ``regexp_extract`` of the rule's group for each value.  A group
  that matches the empty text is a capture too;
* one keyed scan over the lines brings the last capture of every value, and the
  last Record / Clear / Clearall line, to each line.  A value is set on a
  Record line if its capture is younger than the last reset (Filldown: than
  the last Clearall).  Only Record lines leave the scan; no further shuffle;
* Required values: records in which one is unset or empty are skipped; records
  with every value unset are skipped; the end of a file emits the pending
  record unless the template defines an ``EOF`` state (``implicit_eof``);
* List values: the captures of a segment, gathered per record;
* Fillup values: a second keyed scan, backwards.

* ``Error``: a file in which such a rule matches has no records; ``errors``
  returns the first such line of each file.

Supported natively: any states, line actions Next, Continue and Error with Record /
NoRecord / Clear / Clearall and a new state, options Filldown, Required, Key,
List, Fillup.  ``List`` with ``Filldown`` or ``Fillup`` raises
``NotImplementedError``.  ``$$`` in a rule is the end of the line.  The captures of a
List value up to a record are gathered in one row, as they are one value.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hostlens.functions.headings import heading
from hostlens.operators.function_scan import function_scan
from hostlens.operators.scan import keyed_scan

SUPPORTED_OPTIONS = {"Filldown", "Required", "Key", "List", "Fillup"}
LINE_OPS = {"Next", "Continue", "Error"}
RECORD_OPS = {"Record", "NoRecord", "Clear", "Clearall"}
#: States that end a file; they hold no rules.
START, END, EOF, ERROR = "Start", "End", "EOF", "Error"


@dataclass(frozen=True)
class Value:
    name: str
    regex: str
    options: tuple[str, ...] = ()

    @property
    def filldown(self) -> bool:
        return "Filldown" in self.options

    @property
    def required(self) -> bool:
        return "Required" in self.options

    @property
    def listed(self) -> bool:
        return "List" in self.options

    @property
    def fillup(self) -> bool:
        return "Fillup" in self.options


@dataclass(frozen=True)
class Rule:
    pattern: str          # Java regex with the value groups substituted
    groups: dict          # value name -> group index
    record_op: str        # Record | NoRecord | Clear | Clearall
    goes_on: bool = False  # Continue: the line is also offered to the rules below
    state: str = START     # the state the rule belongs to
    target: str | None = None   # the state after the line, if it changes; Error for an error rule
    message: str = ""      # of an error rule


@dataclass(frozen=True)
class Template:
    values: tuple[Value, ...]
    rules: tuple[Rule, ...]
    has_eof_state: bool
    states: tuple[str, ...] = (START,)

    def machine(self) -> list[str]:
        """All states by number: Start, the others, then those that end a file."""
        return [START, *[s for s in self.states if s != START], END, EOF, ERROR]

    @property
    def changes_state(self) -> bool:
        return any(r.target not in (None, r.state) for r in self.rules)


def _capturing_groups(regex: str) -> int:
    n, i, in_class = 0, 0, False
    while i < len(regex):
        ch = regex[i]
        if ch == "\\":
            i += 2
            continue
        if in_class:
            in_class = ch != "]"
        elif ch == "[":
            in_class = True
            if regex[i + 1:i + 2] == "]":
                i += 1
        elif ch == "(":
            nxt = regex[i + 1:i + 3]
            if not nxt.startswith("?") or (nxt == "?P" or (nxt == "?<" and regex[i + 3:i + 4] not in ("=", "!"))):
                n += 1
        i += 1
    return n


def _to_java(regex: str) -> str:
    return regex.replace("(?P<", "(?<")


def parse_template(text: str, unescape: bool = False) -> Template:
    """Read a template.  ``unescape`` turns doubled backslashes into single
    ones (templates posted from a web form arrive escaped)."""
    values: list[Value] = []
    rules: list[Rule] = []
    states: list[str] = []
    lines = (text.replace("\\\\", "\\") if unescape else text).splitlines()
    it = iter(lines)
    for raw in it:
        line = raw.rstrip()
        if not line.strip():
            if values:
                break
            continue
        if line.lstrip().startswith("#"):
            continue
        if not line.startswith("Value "):
            raise ValueError(f"expected a Value line, got {line!r}")
        parts = line.split(None, 3)
        if len(parts) == 4 and not parts[2].startswith("("):
            opts, name, regex = tuple(parts[1].split(",")), parts[2], parts[3]
        else:
            opts, name, regex = (), parts[1], line.split(None, 2)[2]
        for o in opts:
            if o not in SUPPORTED_OPTIONS:
                raise NotImplementedError(f"value option {o} is not supported natively")
        if "List" in opts and {"Filldown", "Fillup"} & set(opts):
            raise NotImplementedError("List with Filldown or Fillup is not supported natively")
        values.append(Value(name, regex.strip(), opts))
    by_name = {v.name: v for v in values}
    state = None
    for raw in it:
        line = raw.rstrip()
        if not line.strip() or line.lstrip().startswith("#"):
            continue
        if not line[0].isspace():
            state = line.strip()
            if not re.fullmatch(r"\w+", state) or state in states or state in LINE_OPS | RECORD_OPS:
                raise ValueError(f"no name of a state, or the second of that name: {state!r}")
            states.append(state)
            continue
        if state in (None, END, EOF):
            raise ValueError(f"no rules stand in state {state}")
        body = line.strip()
        if not body.startswith("^"):
            raise ValueError(f"rule must start with ^: {body!r}")
        pat, _, action = body.partition(" -> ")
        line_op, record_op, target, message = _action(action.strip())
        # substitute ${name} / $name; $$ is the end of the line
        groups: dict[str, int] = {}
        out = ""
        i = 0
        while i < len(pat):
            m = re.match(r"\$\{(\w+)\}|\$(\w+)|\$\$", pat[i:])
            if m and pat[i] == "$":
                tok = m.group(0)
                if tok == "$$":
                    out += "$"
                else:
                    name = m.group(1) or m.group(2)
                    v = by_name[name]
                    groups[name] = _capturing_groups(out) + 1
                    out += v.regex
                i += len(tok)
                continue
            out += pat[i]
            i += 1
        rules.append(Rule(_to_java(out), groups, record_op, line_op == "Continue", state, ERROR if line_op == "Error" else target, message))
    if START not in states:
        raise ValueError("a template needs a Start state")
    for r in rules:
        if r.target not in (None, END, EOF, ERROR, *states):
            raise ValueError(f"no such state: {r.target}")
    return Template(tuple(values), tuple(rules), EOF in states, tuple(s for s in states if s not in (END, EOF)))


def _action(text: str) -> tuple[str, str, str | None, str]:
    """(line action, record action, new state, message) of what stands behind the arrow:
    ``[line action][.record action] [new state]``, each part optional."""
    m = re.fullmatch(r"(?:(\w+)(?:\.(\w+))?)?\s*(?:(\w+)|\"(.*)\")?", text)
    if not m:
        raise ValueError(f"no action: {text!r}")
    first, second, target, message = m.groups()
    line_op, record_op = "Next", "NoRecord"
    if first in LINE_OPS:
        line_op, record_op = first, second or "NoRecord"
    elif first in RECORD_OPS and second is None:
        record_op = first
    elif first and second is None and target is None:
        target = first
    elif first:
        raise ValueError(f"no action: {text!r}")
    if record_op not in RECORD_OPS or (message is not None and line_op != "Error") or (target in LINE_OPS | RECORD_OPS):
        raise ValueError(f"no action: {text!r}")
    if line_op == "Continue" and target is not None:
        raise ValueError("a Continue rule has no new state")
    return line_op, record_op, None if line_op == "Error" else target, message or (target if line_op == "Error" else "") or ""


def extract(lines: DataFrame, template: Template | str, *, file_col: str = "file",
            order_cols=("line_no",), text_col: str = "line", carry_across_files: bool = False,
            implicit_eof: bool = True, title_headings: bool = True) -> DataFrame:
    """Records as rows: ``file``, ``record_no`` and one string column per value
    (headings normalised: ``total_calls`` -> ``Total Calls``); List values are arrays.

    ``order_cols`` give the line order inside a file (``line_no``, or the read
    position ``_block, _mid`` of ``raw_lines`` -- no numbering pass needed).
    """
    t = parse_template(template) if isinstance(template, str) else template
    vals = list(t.values)
    ocols = [order_cols] if isinstance(order_cols, str) else list(order_cols)
    onames = [f"_o{i}" for i in range(len(ocols))]
    base = lines.select(F.col(file_col).alias("_file"), F.col(text_col).alias("_line"),
                        *[F.col(c).alias(o) for c, o in zip(ocols, onames)])
    # a file's lines need no file in their order, nor in the places that the scans carry
    base = base.withColumn("_key", F.lit("")) if carry_across_files else base.withColumnRenamed("_file", "_key")
    own = ["_file"] if carry_across_files else []
    machine = t.machine()
    if t.changes_state:
        base = _in_states(base, t, [*own, *onames])
        if ERROR in [r.target for r in t.rules]:
            bad = base.where(F.col("_after") == machine.index(ERROR)).select("_key").distinct()
            base = base.join(bad, "_key", "left_anti")
    else:
        base = base.withColumns({"_before": F.lit(0), "_after": F.lit(0)})
    base = _applied(base, t)
    rule = F.col("_rule")

    def op_flag(*ops):
        idx = [i for i, r in enumerate(t.rules) if r.record_op in ops]
        return F.coalesce(rule.isin(idx), F.lit(False)) if idx else F.lit(False)

    def capture(v: Value):
        c = F.lit(None).cast("string")
        for i, r in enumerate(t.rules):
            if v.name in r.groups:
                c = F.when(rule == i, F.regexp_extract("_line", r.pattern, r.groups[v.name])).otherwise(c)
        return c

    step = [*own, *onames, "_rule_no"]
    base = base.select("_key", *step, "_after", op_flag("Record").alias("_rec"), op_flag("Record", "Clear", "Clearall").alias("_reset"),
                       op_flag("Clearall").alias("_reset_all"), *[capture(v).alias("_c_" + v.name) for v in vals])
    here = F.struct(*step)

    def stamped(v: Value):
        return F.when(F.col("_c_" + v.name).isNotNull(), F.struct(here.alias("at"), F.col("_c_" + v.name).alias("v")))

    plain = [v for v in vals if not v.listed]
    seg = keyed_scan(base, "_key", [F.col(c) for c in step], sums={"_seg": F.col("_reset")},
                     fills={"_f_" + v.name: stamped(v) for v in plain},
                     befores={"_cleared": F.when(F.col("_reset"), here), "_cleared_all": F.when(F.col("_reset_all"), here)},
                     mark_last="_key_end")
    # a line closes its segment with a record; the last line of a file also stands for the end of input
    end = F.lit(implicit_eof and not t.has_eof_state) & F.col("_key_end") & (F.col("_after") != machine.index(END))
    at_end = seg.select("*", F.explode(F.filter(F.array(F.when(F.col("_rec"), F.lit(False)), F.when(end, F.lit(True))),
                                                lambda x: x.isNotNull())).alias("_eof"))
    cleared = F.when(F.col("_eof") & F.col("_reset"), here).otherwise(F.col("_cleared"))
    cleared_all = F.when(F.col("_eof") & F.col("_reset_all"), here).otherwise(F.col("_cleared_all"))

    def value(v: Value):
        f, since = F.col("_f_" + v.name), cleared_all if v.filldown else cleared
        return F.when(f.isNotNull() & (since.isNull() | (f["at"] > since)), f["v"])

    number = F.col("_seg") - F.when(F.col("_reset") & ~F.col("_eof"), F.lit(1)).otherwise(F.lit(0))
    records = at_end.select("_key", *step, number.alias("_no"), *[value(v).alias(v.name) for v in plain])
    for v in vals:
        if v.listed:
            own = F.col("_seg") - F.col("_reset").cast("long")
            got = (seg.where(F.col("_c_" + v.name).isNotNull()).groupBy("_key", own.alias("_no"))
                   .agg(F.array_sort(F.collect_list(F.struct(here.alias("at"), F.col("_c_" + v.name).alias("v")))).alias("_l")))
            records = (records.join(got, ["_key", "_no"], "left").withColumn(v.name, F.transform("_l", lambda x: x["v"])).drop("_l"))
    keep = F.lit(False)
    for v in vals:
        keep = keep | F.col(v.name).isNotNull()
    for v in vals:
        if v.required:
            keep = keep & F.coalesce((F.size(v.name) > 0) if v.listed else F.col(v.name) != "", F.lit(False))
    records = records.where(keep)
    ups = [v for v in vals if v.fillup]
    if ups:
        records = _filled_up(records, seg, ups, step, onames)
    empty = {v.name: F.array().cast("array<string>") if v.listed else F.lit("") for v in vals}
    return records.select(
        F.col("_file" if carry_across_files else "_key").alias("file"), F.col("_no").alias("record_no"),
        *[F.coalesce(F.col(v.name), empty[v.name]).alias(heading(v.name, title_headings) if title_headings else v.name)
          for v in vals])


def errors(lines: DataFrame, template: Template | str, *, file_col: str = "file", order_cols=("line_no",), text_col: str = "line",
           carry_across_files: bool = False) -> DataFrame:
    """(file, the order columns, line, message): the line at which an Error rule matched, for each file that has one
    (``carry_across_files``: the first of all)."""
    t = parse_template(template) if isinstance(template, str) else template
    ocols = [order_cols] if isinstance(order_cols, str) else list(order_cols)
    onames = [f"_o{i}" for i in range(len(ocols))]
    base = lines.select(F.col(file_col).alias("_file"), F.col(text_col).alias("_line"), *[F.col(c).alias(o) for c, o in zip(ocols, onames)])
    file = "_file" if carry_across_files else "_key"
    base = _in_states(base.withColumn("_key", F.lit("")), t, ["_file", *onames]) if carry_across_files else _in_states(
        base.withColumnRenamed("_file", "_key"), t, onames)
    at = t.machine().index(ERROR)
    hit = _applied(base.where((F.col("_after") == at) & (F.col("_before") != at)), t)
    message = F.lit(None).cast("string")
    for i, r in enumerate(t.rules):
        if r.target == ERROR:
            message = F.when(F.col("_rule") == i, F.lit(r.message)).otherwise(message)
    return (hit.withColumn("message", message).where("message is not null")
            .select(F.col(file).alias("file"), *[F.col(o).alias(c) for o, c in zip(onames, ocols)], F.col("_line").alias("line"), "message"))


def _in_states(base: DataFrame, t: Template, order: list[str]) -> DataFrame:
    """``base`` with the state before and after each line, by number."""
    machine, line = t.machine(), F.col("_line")
    step = []
    for at, state in enumerate(machine):
        to = F.lit(at)
        for r in reversed([r for r in t.rules if r.state == state and not r.goes_on]):
            to = F.when(line.rlike(r.pattern), F.lit(machine.index(r.target) if r.target else at)).otherwise(to)
        step.append(to)
    return function_scan(base, "_key", order, F.array(*step), states=len(machine))


def _applied(base: DataFrame, t: Template) -> DataFrame:
    """``base`` with the rule that applies to a line in its state (``_rule``, null if none); a line
    that goes on after a Continue rule is one row per rule, numbered by ``_rule_no``."""
    line, by_state = F.col("_line"), []
    for at, state in enumerate(t.machine()):
        own = [(i, r) for i, r in enumerate(t.rules) if r.state == state]
        if own:
            by_state.append((F.col("_before") == at, own))
    if not any(r.goes_on for r in t.rules):
        rule = F.lit(None).cast("int")
        for here, own in by_state:
            first = F.lit(None).cast("int")
            for i, r in reversed(own):
                first = F.when(line.rlike(r.pattern), F.lit(i)).otherwise(first)
            rule = F.when(here, first).otherwise(rule)
        return base.withColumn("_rule", rule).withColumn("_rule_no", F.lit(0))
    hits = []
    for here, own in by_state:
        open_ = here
        for i, r in own:
            hit = line.rlike(r.pattern)
            hits.append(F.when(open_ & hit, F.lit(i)))
            if not r.goes_on:
                open_ = open_ & ~F.coalesce(hit, F.lit(False))
    found = F.filter(F.array(*hits), lambda x: x.isNotNull())
    return (base.select("*", F.posexplode_outer(found).alias("_rule_no", "_rule"))
            .withColumn("_rule_no", F.coalesce("_rule_no", F.lit(0))))


def _filled_up(records: DataFrame, seg: DataFrame, ups: list[Value], step: list[str], onames: list[str]) -> DataFrame:
    """Fillup: an empty value of a record takes the next capture that is not empty, which may
    stand on a line that no record holds.  One keyed scan backwards over records and captures."""
    caught = seg.where(" or ".join(f"coalesce(`_c_{v.name}`, '') != ''" for v in ups)).select(
        "_key", *step, *[F.nullif(F.col("_c_" + v.name), F.lit("")).alias("_u_" + v.name) for v in ups], F.lit(False).alias("_is_rec"))
    rows = records.withColumn("_is_rec", F.lit(True)).unionByName(caught, allowMissingColumns=True)
    back = [F.col(o) * -1 for o in [*onames, "_rule_no"]]
    # a record's own captures are not after it: at one line the record comes first in reverse order's end
    scanned = keyed_scan(rows, "_key", [*back, F.when(F.col("_is_rec"), 0).otherwise(1), F.col("_no")],
                         fills={"_next_" + v.name: "_u_" + v.name for v in ups})
    for v in ups:
        scanned = scanned.withColumn(v.name, F.when(F.coalesce(F.col(v.name), F.lit("")) == "", F.col("_next_" + v.name)).otherwise(F.col(v.name)))
    return scanned.where("_is_rec")
