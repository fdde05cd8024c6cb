"""Coordinate transformations in closed form, as column expressions.

Known systems: geographic ones, Mercator, transverse Mercator (Krueger's series), Lambert conformal conic
and oblique stereographic, by EPSG code.  Between datums coordinates go through the earth-centred frame and
a transformation of seven parameters, at the height of the local datum's ellipsoid in both directions;
grids of corrections are not used.
Inverse latitudes come from the series in the third flattening, so that no expression iterates.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Pair = tuple[Column, Column]


@dataclass(frozen=True)
class Ellipsoid:
    a: float
    inverse_flattening: float

    @cached_property
    def f(self) -> float:
        return 1 / self.inverse_flattening if self.inverse_flattening else 0.0

    @cached_property
    def e(self) -> float:
        return math.sqrt(self.f * (2 - self.f))

    @cached_property
    def n(self) -> float:
        return self.f / (2 - self.f)

    def isometric(self, phi: float) -> float:
        return math.asinh(math.tan(phi)) - self.e * math.atanh(self.e * math.sin(phi))

    def isometric_column(self, phi: Column) -> Column:
        """NaN beyond the poles."""
        t = F.tan(math.pi / 4 + phi / 2)
        return F.when(t > 0, F.log(t)).otherwise(float("nan")) - self.e * F.atanh(self.e * F.sin(phi))

    def latitude(self, chi: Column) -> Column:
        """Geographic latitude of a conformal one."""
        n = self.n
        terms = (2 * n - 2 / 3 * n**2 - 2 * n**3 + 116 / 45 * n**4, 7 / 3 * n**2 - 8 / 5 * n**3 - 227 / 45 * n**4, 56 / 15 * n**3 - 136 / 35 * n**4, 4279 / 630 * n**4)
        return chi + sum((c * F.sin(2 * (k + 1) * chi) for k, c in enumerate(terms)), F.lit(0.0))

    def latitude_of_isometric(self, psi: Column) -> Column:
        return self.latitude(F.atan(F.sinh(psi)))


@dataclass(frozen=True)
class Geographic:
    """Degrees."""

    ellipsoid: Ellipsoid

    def forward(self, lon: Column, lat: Column) -> Pair:
        return F.degrees(lon), F.degrees(lat)

    def inverse(self, x: Column, y: Column) -> Pair:
        return F.radians(x), F.radians(y)


@dataclass(frozen=True)
class Mercator:
    ellipsoid: Ellipsoid
    lon0: float = 0.0
    k0: float = 1.0
    east: float = 0.0
    north: float = 0.0

    def forward(self, lon: Column, lat: Column) -> Pair:
        r = self.ellipsoid.a * self.k0
        return self.east + r * (lon - math.radians(self.lon0)), self.north + r * self.ellipsoid.isometric_column(lat)

    def inverse(self, x: Column, y: Column) -> Pair:
        r = self.ellipsoid.a * self.k0
        return (x - self.east) / r + math.radians(self.lon0), self.ellipsoid.latitude_of_isometric((y - self.north) / r)


@dataclass(frozen=True)
class TransverseMercator:
    ellipsoid: Ellipsoid
    lat0: float
    lon0: float
    k0: float
    east: float
    north: float

    @cached_property
    def _a(self) -> float:
        n = self.ellipsoid.n
        return self.k0 * self.ellipsoid.a / (1 + n) * (1 + n**2 / 4 + n**4 / 64)

    @cached_property
    def _alpha(self) -> tuple[float, ...]:
        n = self.ellipsoid.n
        return n / 2 - 2 / 3 * n**2 + 5 / 16 * n**3 + 41 / 180 * n**4, 13 / 48 * n**2 - 3 / 5 * n**3 + 557 / 1440 * n**4, 61 / 240 * n**3 - 103 / 140 * n**4, 49561 / 161280 * n**4

    @cached_property
    def _beta(self) -> tuple[float, ...]:
        n = self.ellipsoid.n
        return n / 2 - 2 / 3 * n**2 + 37 / 96 * n**3 - 1 / 360 * n**4, 1 / 48 * n**2 + 1 / 15 * n**3 - 437 / 1440 * n**4, 17 / 480 * n**3 - 37 / 840 * n**4, 4397 / 161280 * n**4

    @cached_property
    def _origin(self) -> float:
        chi = math.atan(math.sinh(self.ellipsoid.isometric(math.radians(self.lat0))))
        return self._a * (chi + sum(c * math.sin(2 * (k + 1) * chi) for k, c in enumerate(self._alpha)))

    def forward(self, lon: Column, lat: Column) -> Pair:
        # the isometric latitude by the sine, which stays in the map beyond a pole
        t, d = F.sinh(F.atanh(F.sin(lat)) - self.ellipsoid.e * F.atanh(self.ellipsoid.e * F.sin(lat))), lon - math.radians(self.lon0)
        xi, eta = F.atan2(t, F.cos(d)), F.atanh(F.sin(d) / F.sqrt(1 + t * t))
        y = xi + sum((c * F.sin(2 * (k + 1) * xi) * F.cosh(2 * (k + 1) * eta) for k, c in enumerate(self._alpha)), F.lit(0.0))
        x = eta + sum((c * F.cos(2 * (k + 1) * xi) * F.sinh(2 * (k + 1) * eta) for k, c in enumerate(self._alpha)), F.lit(0.0))
        return self.east + self._a * x, self.north - self._origin + self._a * y

    def inverse(self, x: Column, y: Column) -> Pair:
        xi, eta = (y - self.north + self._origin) / self._a, (x - self.east) / self._a
        u = xi - sum((c * F.sin(2 * (k + 1) * xi) * F.cosh(2 * (k + 1) * eta) for k, c in enumerate(self._beta)), F.lit(0.0))
        v = eta - sum((c * F.cos(2 * (k + 1) * xi) * F.sinh(2 * (k + 1) * eta) for k, c in enumerate(self._beta)), F.lit(0.0))
        return F.atan2(F.sinh(v), F.cos(u)) + math.radians(self.lon0), self.ellipsoid.latitude(F.asin(F.sin(u) / F.cosh(v)))


@dataclass(frozen=True)
class LambertConic:
    """Conformal conic; of one standard parallel with a scale, or of two."""

    ellipsoid: Ellipsoid
    lat0: float
    lon0: float
    parallels: tuple[float, ...] = ()
    k0: float = 1.0
    east: float = 0.0
    north: float = 0.0

    @cached_property
    def _cone(self) -> tuple[float, float, float]:
        """The cone's constant, the scale of radii, and the radius of the origin."""
        q = self.ellipsoid
        m = lambda phi: math.cos(phi) / math.sqrt(1 - (q.e * math.sin(phi)) ** 2)
        p = [math.radians(v) for v in self.parallels or (self.lat0,)]
        n = (math.log(m(p[0])) - math.log(m(p[1]))) / (q.isometric(p[1]) - q.isometric(p[0])) if len(p) == 2 and p[0] != p[1] else math.sin(p[0])
        scale = q.a * self.k0 * m(p[0]) / n * math.exp(n * q.isometric(p[0]))
        return n, scale, scale * math.exp(-n * q.isometric(math.radians(self.lat0)))

    def forward(self, lon: Column, lat: Column) -> Pair:
        n, scale, r0 = self._cone
        r, theta = scale * F.exp(-n * self.ellipsoid.isometric_column(lat)), n * (lon - math.radians(self.lon0))
        return self.east + r * F.sin(theta), self.north + r0 - r * F.cos(theta)

    def inverse(self, x: Column, y: Column) -> Pair:
        n, scale, r0 = self._cone
        s = math.copysign(1.0, n)
        dx, dy = s * (x - self.east), s * (r0 - (y - self.north))
        psi = F.log(F.sqrt(dx * dx + dy * dy) / abs(scale)) / -n
        return F.atan2(dx, dy) / n + math.radians(self.lon0), self.ellipsoid.latitude_of_isometric(psi)


@dataclass(frozen=True)
class ObliqueStereographic:
    ellipsoid: Ellipsoid
    lat0: float
    lon0: float
    k0: float
    east: float
    north: float

    @cached_property
    def _sphere(self) -> tuple[float, float, float, float]:
        """Twice the scaled radius, the exponent, the factor, and the origin's latitude on the sphere."""
        q, phi = self.ellipsoid, math.radians(self.lat0)
        s, e2 = math.sin(phi), q.e**2
        radius = q.a * math.sqrt(1 - e2) / (1 - e2 * s * s)
        n = math.sqrt(1 + e2 * math.cos(phi) ** 4 / (1 - e2))
        w = math.exp(2 * n * q.isometric(phi))
        sin0 = (w - 1) / (w + 1)
        c = (n + s) * (1 - sin0) / ((n - s) * (1 + sin0))
        return 2 * radius * self.k0, n, c, math.asin((c * w - 1) / (c * w + 1))

    def forward(self, lon: Column, lat: Column) -> Pair:
        r, n, c, chi0 = self._sphere
        w = c * F.exp(2 * n * self.ellipsoid.isometric_column(lat))
        chi, d = F.asin((w - 1) / (w + 1)), n * (lon - math.radians(self.lon0))
        b = 1 + F.sin(chi) * math.sin(chi0) + F.cos(chi) * math.cos(chi0) * F.cos(d)
        return self.east + r * F.cos(chi) * F.sin(d) / b, self.north + r * (F.sin(chi) * math.cos(chi0) - F.cos(chi) * math.sin(chi0) * F.cos(d)) / b

    def inverse(self, x: Column, y: Column) -> Pair:
        r, n, c, chi0 = self._sphere
        dx, dy = (x - self.east) / r, (y - self.north) / r
        rho = F.sqrt(dx * dx + dy * dy)
        angle = 2 * F.atan(rho)
        part = F.when(rho == 0, F.lit(0.0)).otherwise(dy * F.sin(angle) / F.nullif(rho, F.lit(0.0)))
        chi = F.asin(F.cos(angle) * math.sin(chi0) + part * math.cos(chi0))
        d = F.atan2(dx * F.sin(angle), rho * math.cos(chi0) * F.cos(angle) - dy * math.sin(chi0) * F.sin(angle))
        psi = (F.log((1 + F.sin(chi)) / (1 - F.sin(chi))) - math.log(c)) / (2 * n)
        return d / n + math.radians(self.lon0), self.ellipsoid.latitude_of_isometric(psi)


Projection = Geographic | Mercator | TransverseMercator | LambertConic | ObliqueStereographic


@dataclass(frozen=True)
class System:
    """A projection, and the seven parameters of its datum to WGS 84 (position vector; metres, seconds, parts a million)."""

    projection: Projection
    to_wgs84: tuple[float, ...] = field(default=())

    @property
    def projected(self) -> bool:
        return not isinstance(self.projection, Geographic)

    def frame(self) -> tuple[np.ndarray, np.ndarray]:
        """Matrix and shift to WGS 84 in the earth-centred frame."""
        if not self.to_wgs84:
            return np.eye(3), np.zeros(3)
        dx, dy, dz, *turn, ppm = self.to_wgs84
        rx, ry, rz = (math.radians(v / 3600) for v in turn)
        return (1 + ppm * 1e-6) * np.array([[1, -rz, ry], [rz, 1, -rx], [-ry, rx, 1]]), np.array([dx, dy, dz])


#: Ellipsoids and parameters of the EPSG registry.
WGS84, GRS80, BESSEL = Ellipsoid(6378137.0, 298.257223563), Ellipsoid(6378137.0, 298.257222101), Ellipsoid(6377397.155, 299.1528128)
AIRY, INTERNATIONAL = Ellipsoid(6377563.396, 299.3249646), Ellipsoid(6378388.0, 297.0)
AMERSFOORT = (565.2369, 50.0087, 465.658, -0.406857330322398, 0.350732676542563, -1.8703473836068, 4.0812)
OSGB36 = (446.448, -125.157, 542.06, 0.15, 0.247, 0.842, -20.489)
BELGE72 = (-106.8686, 52.2978, -103.7239, 0.3366, -0.457, 1.8422, -1.2747)
SYSTEMS: dict[int, System] = {
    4326: System(Geographic(WGS84)),
    4258: System(Geographic(GRS80)),
    4289: System(Geographic(BESSEL), AMERSFOORT),
    4277: System(Geographic(AIRY), OSGB36),
    3857: System(Mercator(Ellipsoid(6378137.0, 0.0))),
    3395: System(Mercator(WGS84)),
    28992: System(ObliqueStereographic(BESSEL, 52 + 9 / 60 + 22.178 / 3600, 5 + 23 / 60 + 15.5 / 3600, 0.9999079, 155000.0, 463000.0), AMERSFOORT),
    27700: System(TransverseMercator(AIRY, 49.0, -2.0, 0.9996012717, 400000.0, -100000.0), OSGB36),
    2154: System(LambertConic(GRS80, 46.5, 3.0, (49.0, 44.0), 1.0, 700000.0, 6600000.0)),
    3034: System(LambertConic(GRS80, 52.0, 10.0, (35.0, 65.0), 1.0, 4000000.0, 2800000.0)),
    3812: System(LambertConic(GRS80, 50.797815, 4 + 21 / 60 + 33.177 / 3600, (49 + 50 / 60, 51 + 10 / 60), 1.0, 649328.0, 665262.0)),
    31370: System(LambertConic(INTERNATIONAL, 90.0 - 1e-12, 4 + 22 / 60 + 2.952 / 3600, (51 + 10 / 60 + 0.00204 / 3600, 49 + 50 / 60 + 0.00204 / 3600), 1.0, 150000.013, 5400088.438), BELGE72),
}


def system(code: int) -> System:
    """The system of an EPSG code; zones of UTM by rule."""
    if code in SYSTEMS:
        return SYSTEMS[code]
    zone, base = code % 100, code // 100
    if base in (326, 327) and 1 <= zone <= 60:
        return System(TransverseMercator(WGS84, 0.0, 6.0 * zone - 183, 0.9996, 500000.0, 10000000.0 if base == 327 else 0.0))
    if base == 258 and 28 <= zone <= 38:
        return System(TransverseMercator(GRS80, 0.0, 6.0 * zone - 183, 0.9996, 500000.0, 0.0))
    raise ValueError(f"EPSG:{code} is not among the known systems")


def _shifted(lon: Column, lat: Column, height: Column, one: System, two: System) -> tuple[Column, Column, Column]:
    """Longitude, latitude and height on the datum of ``two``, through the earth-centred frame."""
    p, q = one.projection.ellipsoid, two.projection.ellipsoid
    (m, t), (back, u) = one.frame(), two.frame()
    whole, move = np.linalg.inv(back) @ m, np.linalg.inv(back) @ (t - u)
    nu = p.a / F.sqrt(1 - p.e**2 * F.sin(lat) * F.sin(lat))
    at = ((nu + height) * F.cos(lat) * F.cos(lon), (nu + height) * F.cos(lat) * F.sin(lon), (nu * (1 - p.e**2) + height) * F.sin(lat))
    x, y, z = (sum((float(whole[k, i]) * at[i] for i in range(3)), F.lit(float(move[k]))) for k in range(3))
    b, e2 = q.a * (1 - q.f), q.e**2
    r = F.sqrt(x * x + y * y)
    theta = F.atan2(z * q.a, r * b)
    phi = F.atan2(z + e2 / (1 - e2) * b * F.pow(F.sin(theta), 3), r - e2 * q.a * F.pow(F.cos(theta), 3))
    return F.atan2(y, x), phi, r * F.cos(phi) + z * F.sin(phi) - q.a * F.sqrt(1 - e2 * F.sin(phi) * F.sin(phi))


def transform(df: DataFrame, x: str, y: str, source: int | System, target: int | System) -> DataFrame:
    """``df`` with the coordinates in ``x`` and ``y`` transformed between two systems, given by EPSG code or as such."""
    one, two = (s if isinstance(s, System) else system(s) for s in (source, target))
    lon, lat = one.projection.inverse(F.col(x), F.col(y))
    # each stage is a projection of its own, whose columns the next one reads several times
    stage = df.withColumns({"_lon": lon, "_lat": lat})
    if one.to_wgs84 != two.to_wgs84:  # else the same datum, or WGS 84 and ETRS 89, whose ellipsoids are a tenth of a millimetre apart
        shift = lambda h: _shifted(F.col("_lon"), F.col("_lat"), h, one, two)
        height = F.lit(0.0)
        if two.to_wgs84 and not one.to_wgs84:  # the height at which the place lies on the local ellipsoid
            stage, height = stage.withColumn("_h", -shift(height)[2]), F.col("_h")
        lon, lat, _ = shift(height)
        stage = stage.withColumns({"_lon": lon, "_lat": lat})
    east, north = two.projection.forward(F.col("_lon"), F.col("_lat"))
    return stage.withColumns({x: east, y: north}).select(*df.columns)
