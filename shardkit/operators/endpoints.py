"""Lists of data source addresses in a text column, brought into one form."""

from dataclasses import dataclass
from urllib.parse import quote

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shardkit.functions.numbers import SPACES

# Between addresses; with a scheme; an address's parts; scheme of the result.
SEPARATOR_RE = f"[,{SPACES}]+"
SCHEME_RE = r"^\w+://(.*)$"
PARTS_RE = r"^(?:([^/?#]*)@)?(\[[^\]]*\]|[^/?#:@]*)(?::(\d*))?(/[^?#]*)?(\?[^#]*)?(#.*)?$"
RESULT_SCHEME = "postgresql://"

# Port that addresses never show, as it is the default of their URL form.
HIDDEN_PORT = "443"

# Required parts, in the order in which their absence is reported.
REQUIRED = ["username", "password", "hostname", "database"]


@dataclass(frozen=True)
class EndpointDefaults:
    """Values for the parts an address leaves out."""

    user: str = ""
    password: str = ""
    host: str = ""
    port: str = ""
    database: str = ""
    sslmode: str = ""


def normalize_endpoint(address: Column, defaults: EndpointDefaults) -> Column:
    """An address, `scheme://…` or `host[:port][/database]`, as struct<endpoint, missing>.

    `missing` names the first required part that neither address nor defaults give.
    """
    has_scheme = address.rlike(SCHEME_RE)
    rest = F.regexp_extract(address, SCHEME_RE, 1)
    # without a scheme, everything behind the slash is the database's name
    bare = F.replace(F.replace(address, F.lit("?"), F.lit("%3F")), F.lit("#"), F.lit("%23"))
    text = F.when(has_scheme, F.coalesce(F.nullif(rest, F.lit("")), F.lit(defaults.host))).otherwise(bare)

    def part(group: int) -> Column:
        return F.regexp_extract(text, PARTS_RE, group)

    def either(value: Column, default: str) -> Column:
        return F.when(value == "", F.lit(default)).otherwise(value)

    account = F.split(part(1), ":", 2)
    user = either(F.get(account, 0), quote(defaults.user, safe="!$%&'()*+,-._~"))
    password = either(F.coalesce(F.get(account, 1), F.lit("")), quote(defaults.password, safe="!$%&'()*+,-._~"))
    host = F.lower(part(2))
    port = either(F.when(part(3) == HIDDEN_PORT, F.lit("")).otherwise(part(3)), defaults.port)
    port = F.when(port == HIDDEN_PORT, F.lit("")).otherwise(port)
    path = F.when(part(4).isin("", "/"), F.lit("/" + defaults.database)).otherwise(part(4))
    query = part(5)
    if defaults.sslmode:
        query = F.concat(
            F.when(F.length(query) > 1, F.concat(query, F.lit("&"))).otherwise(F.lit("?")),
            F.lit(f"sslmode={defaults.sslmode}"),
        )
    absent = [user == "", password == "", host == "", path == "/"]
    missing = F.coalesce(*[F.when(is_absent, F.lit(name)) for is_absent, name in zip(absent, REQUIRED)])
    endpoint = F.concat(
        F.lit(RESULT_SCHEME), user, F.lit(":"), password, F.lit("@"), host,
        F.when(port == "", F.lit("")).otherwise(F.concat(F.lit(":"), port)), path, query, part(6),
    )
    return F.struct(F.when(missing.isNull(), endpoint).alias("endpoint"), missing.alias("missing"))


def normalize_endpoints(
    df: DataFrame,
    col: str,
    key: str,
    defaults: EndpointDefaults,
    roles: DataFrame | None = None,
    numbered: list[str] | None = None,
) -> DataFrame:
    """Addresses of every row's list as (key, position, endpoint, missing).

    The first of equal endpoints of a row stays. With `roles` (endpoint, role),
    only primaries do. Rows whose address lacks a required part stay and name it.
    With `numbered`, a number stands for the address at that position of it, and
    for nothing beyond its end.
    """
    def parsed(address: Column, position: Column) -> Column:
        if numbered is not None:
            known = F.get(F.array(*[F.lit(a) for a in numbered]).cast("array<string>"), address.try_cast("int"))
            address = F.when(address.rlike(r"^\d+$"), known).otherwise(address)
        found = normalize_endpoint(address, defaults)
        return F.struct(position.alias("position"), address.alias("address"), found.alias("found"))

    def first_of_its_kind(entry: Column) -> Column:
        # a broken address is kept once per spelling, as it has no endpoint to compare
        same = lambda other: other["found"].eqNullSafe(entry["found"]) & (
            entry["found"]["endpoint"].isNotNull() | (other["address"] == entry["address"])
        )
        return ~F.exists("_listed", lambda other: (other["position"] < entry["position"]) & same(other))

    # each address is parsed once, and all of a row's are compared within the row
    entries = F.filter(F.transform(F.split(F.col(col), SEPARATOR_RE), parsed), lambda e: e["address"] != "")
    listed = df.select(key, entries.alias("_listed"))
    first = listed.select(key, F.explode(F.filter("_listed", first_of_its_kind)).alias("_e"))
    first = first.select(key, "_e.position", "_e.found.endpoint", "_e.found.missing")
    if roles is not None:
        primaries = roles.filter(F.col("role") == "primary").select("endpoint").distinct()
        first = first.join(primaries, "endpoint", "left_semi")
    return first.select(key, "position", "endpoint", "missing")
