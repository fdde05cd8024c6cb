"""Roles of the variables of a mesh file: topologies, coordinates, dimensions and connectivities by attributes, and CRS.

A file is described on the driver by its variables: ``{name: Variable(dims, shape, attrs)}``.
"""

from __future__ import annotations

import re
import warnings
from dataclasses import dataclass, field

#: Attributes that name connectivities, coordinates and dimensions, by dimension of the topology.
CONNECTIVITY = {1: ("edge_node_connectivity",), 2: ("face_node_connectivity", "edge_node_connectivity", "face_edge_connectivity", "edge_face_connectivity", "face_face_connectivity", "boundary_node_connectivity")}
COORDINATES = {1: ("node_coordinates", "edge_coordinates"), 2: ("node_coordinates", "edge_coordinates", "face_coordinates")}
DIMENSIONS = {1: ("node_dimension", "edge_dimension"), 2: ("node_dimension", "edge_dimension", "face_dimension")}
#: Standard names of x and y coordinates.
X_NAMES = {"projection_x_coordinate": True, "longitude": False}
Y_NAMES = {"projection_y_coordinate": True, "latitude": False}


@dataclass(frozen=True)
class Variable:
    """What is known of a variable without its data."""

    dims: tuple[str, ...] = ()
    shape: tuple[int, ...] = ()
    attrs: dict[str, object] = field(default_factory=dict)


Variables = dict[str, Variable]


def topologies(variables: Variables) -> list[str]:
    """Variables whose role is that of a mesh topology."""
    return [n for n, v in variables.items() if v.attrs.get("cf_role") == "mesh_topology"]


def _dimension(variables: Variables, name: str) -> int:
    return int(variables[name].attrs.get("topology_dimension", 2))


def infer_xy(variables: Variables, candidates: list[str]) -> tuple[list[str], list[str]]:
    """x and y among the candidates by standard name, else the first two with a warning."""
    x = [n for n in candidates if variables[n].attrs.get("standard_name") in X_NAMES]
    y = [n for n in candidates if variables[n].attrs.get("standard_name") in Y_NAMES]
    if x and y:
        return x, y
    if len(candidates) < 2:
        raise ValueError(f"coordinates need an x and a y, found {candidates}")
    warnings.warn(f"no standard names of x and y among {candidates}: the first two are taken", stacklevel=3)
    return candidates[:1], candidates[1:2]


def coordinates(variables: Variables) -> dict[str, dict[str, tuple[list[str], list[str]]]]:
    """For each topology and coordinate role the names of x and y; names without a variable give a warning."""
    out = {}
    for t in topologies(variables):
        out[t] = {}
        for role in COORDINATES[_dimension(variables, t)]:
            named = str(variables[t].attrs.get(role, "")).split()
            for n in named:
                if n not in variables:
                    warnings.warn(f"the coordinate {n} of {t} is missing", stacklevel=2)
            found = [n for n in named if n in variables]
            if found:
                out[t][role] = infer_xy(variables, found)
    return out


def connectivity(variables: Variables) -> dict[str, dict[str, str]]:
    """For each topology the connectivities that are there."""
    out = {}
    for t in topologies(variables):
        named = {r: variables[t].attrs.get(r) for r in CONNECTIVITY[_dimension(variables, t)]}
        for role, n in named.items():
            if n and n not in variables:
                warnings.warn(f"the {role} {n} of {t} is missing", stacklevel=2)
        out[t] = {r: n for r, n in named.items() if n in variables}
    return out


def dimensions(variables: Variables) -> dict[str, dict[str, str]]:
    """For each topology the dimension of each facet, declared or inferred; contradictions raise ``ValueError``."""
    out, places, links = {}, coordinates(variables), connectivity(variables)
    for t in topologies(variables):
        facets = {r: str(variables[t].attrs[r]) for r in DIMENSIONS[_dimension(variables, t)] if r in variables[t].attrs}
        found: dict[str, set[str]] = {}
        for role, names in places[t].items():
            for n in (*names[0], *names[1]):
                if len(variables[n].dims) != 1:
                    raise ValueError(f"the coordinate {n} of {t} must have one dimension")
                found.setdefault(role.replace("coordinates", "dimension"), set()).add(variables[n].dims[0])
        for role, n in links[t].items():
            of, width = role.partition("_")[0], {"edge_node_connectivity": 2, "edge_face_connectivity": 2, "boundary_node_connectivity": 2}.get(role)
            if len(variables[n].dims) != 2:
                raise ValueError(f"{n} must have two dimensions")
            key = f"{of}_dimension"
            if key not in DIMENSIONS[2]:
                continue
            own = [d for d in variables[n].dims if d == facets.get(key)]
            if not own and width is not None:
                own = [d for d, size in zip(variables[n].dims, variables[n].shape) if size != width] or [variables[n].dims[0]]
                if width not in variables[n].shape:
                    raise ValueError(f"{n} must have a dimension of size {width}, not {variables[n].shape}")
            found.setdefault(key, set()).add((own or [variables[n].dims[0]])[0])
        for key, names in found.items():
            names = names | ({facets[key]} if key in facets else set())
            if len(names) > 1:
                raise ValueError(f"{key} of {t} is not one dimension: {sorted(names)}")
            facets[key] = names.pop()
        out[t] = facets
    return out


def grid_mapping_names(variables: Variables) -> dict[str, str | None]:
    """For each topology the grid mapping of the variables on its dimensions; several raise ``ValueError``."""
    out = {}
    for t, facets in dimensions(variables).items():
        own = {str(v.attrs["grid_mapping"]) for v in variables.values() if "grid_mapping" in v.attrs and set(v.dims) & set(facets.values())}
        if len(own) > 1:
            raise ValueError(f"{t} has several grid mappings: {sorted(own)}")
        out[t] = own.pop() if own else None
    return out


def is_projected(variables: Variables) -> dict[str, bool | None]:
    """For each topology whether its node coordinates are projected, by their standard names; None if these do not say."""
    out = {}
    for t, roles in coordinates(variables).items():
        names = [variables[n].attrs.get("standard_name") for pair in roles.values() for part in pair for n in part]
        kinds = {(X_NAMES | Y_NAMES)[n] for n in names if n in X_NAMES | Y_NAMES}
        if len(kinds) > 1:
            raise ValueError(f"the coordinates of {t} are both projected and geographic")
        out[t] = kinds.pop() if kinds else None
    return out


def default_attrs(name: str, dimension: int) -> dict[str, object]:
    """Attributes of a topology variable with default names."""
    if dimension not in (1, 2):
        raise ValueError("a topology has one or two dimensions")
    attrs = {"cf_role": "mesh_topology", "long_name": f"Topology data of {dimension}D {'network' if dimension == 1 else 'mesh'}", "topology_dimension": dimension}
    for facet in ("node", "edge", "face")[: dimension + 1]:
        attrs[f"{facet}_dimension"] = f"{name}_n{facet.capitalize()}s"
        attrs[f"{facet}_coordinates"] = f"{name}_{facet}_x {name}_{facet}_y"
    for role, short in (("edge_node_connectivity", "edge_nodes"), *((("face_node_connectivity", "face_nodes"), ("max_face_nodes_dimension", "nMax_face_nodes"), ("face_edge_connectivity", "face_edges"), ("edge_face_connectivity", "edge_faces"), ("face_face_connectivity", "face_faces"), ("boundary_node_connectivity", "boundary_nodes")) if dimension == 2 else ())):
        attrs[role] = f"{name}_{short}"
    return attrs


# coordinate reference systems by name


@dataclass(frozen=True)
class Crs:
    """A coordinate reference system by EPSG code, or by its text alone."""

    epsg: int | None = None
    text: str | None = None

    @property
    def name(self) -> str | None:
        return f"EPSG:{self.epsg}" if self.epsg is not None else self.text


def crs_of(value: str | int | Crs | None, epsg: int | None = None) -> Crs | None:
    """From a code, a name such as ``EPSG:4326`` or any text; two that differ raise ``ValueError``."""
    if isinstance(value, Crs):
        found = value
    elif value is None:
        found = None
    else:
        m = re.fullmatch(r"(?i)\s*(?:epsg:)?([0-9]+)\s*", str(value))
        found = Crs(int(m[1])) if m else Crs(None, str(value))
    if epsg is not None and found is not None and found.epsg != epsg:
        raise ValueError(f"conflicting CRS: {found.name} and EPSG:{epsg}")
    return found if found is not None else Crs(epsg) if epsg is not None else None


def crs_from_attrs(attrs: dict[str, object]) -> Crs | None:
    """From the attributes of a grid mapping: ``epsg``, ``EPSG_code`` or ``crs_wkt``; codes that differ raise ``ValueError``."""
    codes = set()
    for key in ("epsg", "epsg_code", "EPSG_code", "EPSG"):
        if key in attrs and (m := re.search(r"([0-9]+)", str(attrs[key]))) and int(m[1]) > 0:
            codes.add(int(m[1]))
    text = attrs.get("crs_wkt") or attrs.get("spatial_ref")
    if text and (named := re.findall(r'(?:AUTHORITY|ID)\["EPSG",\s*"?([0-9]+)"?\]+\s*$', str(text))):
        codes.add(int(named[-1]))
    if len(codes) > 1:
        raise ValueError(f"conflicting EPSG codes: {sorted(codes)}")
    return Crs(codes.pop() if codes else None, str(text) if text else None) if codes or text else None


def crs_to_attrs(crs: Crs | None) -> dict[str, object]:
    attrs: dict[str, object] = {}
    if crs is not None and crs.epsg is not None:
        attrs |= {"epsg": crs.epsg, "EPSG_code": crs.name}
    if crs is not None and crs.text:
        attrs["crs_wkt"] = crs.text
    return attrs


def validate_crs(crs: Crs | None, projected: bool | None) -> bool | None:
    """Whether the grid is projected, after the CRS where that says so; a contradiction raises ``ValueError``."""
    said = None
    if crs is not None and crs.text:
        head = crs.text.lstrip().upper()
        said = True if head.startswith("PROJ") else False if head.startswith("GEO") else None
    elif crs is not None and crs.epsg is not None:
        said = False if 4000 <= crs.epsg < 5000 else None  # the codes of geographic systems
    if said is not None and projected is not None and said != projected:
        raise ValueError(f"the CRS is {'projected' if said else 'geographic'}, the coordinates are not")
    return said if said is not None else projected
