"""SQL views the check queries share: the same pixel data as ``plans.fixtures``, written for DuckDB.

All non-integer literals use the exponent form so that both engines read them as DOUBLE.
"""

from __future__ import annotations

VIEWS: dict[str, tuple[str, str]] = {}


def view(name: str, text: str, needs: str = "") -> None:
    VIEWS[name] = (needs, text)


def with_clause(names: str) -> str:
    """WITH clause holding ``names`` and everything they need, in dependency order."""
    order: list[str] = []

    def add(n: str) -> None:
        if n in order:
            return
        needs, _ = VIEWS[n]
        for m in needs.split():
            add(m)
        order.append(n)

    for n in names.split():
        add(n)
    if not order:
        return ""
    return "WITH " + ",\n".join(f"{n} AS ({VIEWS[n][1]})" for n in order) + "\n"


view(
    "px0",
    """SELECT CAST(floor(vec_id/64.0e0) AS BIGINT) image_id, CAST(vec_id % 64 AS INT) y, CAST(x AS INT) x, label,
       150.0e0*exp(10.0e0*v)/179.0e0 rad
  FROM (SELECT vec_id, label, generate_subscripts(embedding,1)-1 x, CAST(unnest(embedding) AS DOUBLE) v FROM embeddings)""",
)
view(
    "px",
    """SELECT image_id, y, x, CAST(label AS INT) label, rad*(0.9e0+0.05e0*((x+label)%5)) r, rad g, rad*(0.8e0+0.1e0*(y%4)) b FROM px0""",
    "px0",
)
view("lum", "SELECT *, 179.0e0*(0.265e0*r+0.670e0*g+0.065e0*b) lum FROM px", "px")
# full 180-degree equidistant picture of 64 x 64: frame coordinates, solid angle, direction
view(
    "geo",
    """SELECT y, x, nx, ny, radius, pi()*radius theta,
       CASE WHEN radius<=0.5e0 THEN pi()*pi()/4096.0e0*sin(pi()*radius)/(pi()*radius) ELSE 0e0 END omega,
       sin(pi()*radius)*nx/radius dx, cos(pi()*radius) dy, -sin(pi()*radius)*ny/radius dz,
       radius<=0.5e0 valid
  FROM (SELECT y, x, (x+0.5e0)/64.0e0-0.5e0 nx, (y+0.5e0)/64.0e0-0.5e0 ny,
               sqrt(((x+0.5e0)/64.0e0-0.5e0)*((x+0.5e0)/64.0e0-0.5e0)+((y+0.5e0)/64.0e0-0.5e0)*((y+0.5e0)/64.0e0-0.5e0)) radius
        FROM (SELECT CAST(range AS INT) y FROM range(64)) a, (SELECT CAST(range AS INT) x FROM range(64)) b)""",
)
view("g", "SELECT lum.*, geo.* EXCLUDE (y, x) FROM lum JOIN geo USING (y, x)", "lum geo")
# inside the circle only
view("gv", "SELECT * FROM g WHERE valid", "g")
view("images", "SELECT DISTINCT image_id, CAST(64 AS INT) width, CAST(64 AS INT) height FROM px", "px")
view(
    "wide",
    """SELECT CAST(l_suppkey AS BIGINT) k, CAST(l_partkey AS BIGINT) p, CAST(l_linenumber AS INT) line, CAST(l_orderkey AS BIGINT) o,
       CAST(l_extendedprice AS DOUBLE)*1.0001234567e0 v, CAST(l_quantity AS DOUBLE) w FROM lineitem""",
)
