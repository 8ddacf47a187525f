"""Lookups in an inventory of devices, incidents and flows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.relational import first_by


def by_name(devices: DataFrame, name: str, column: str = "name") -> DataFrame:
    """The device of that name; a name that isn't there is an error, and none is guessed."""
    found = devices.where(F.col(column) == name)
    if found.isEmpty():
        raise KeyError(name)
    return found


def by_role(devices: DataFrame, role: str, seq: str = "seq") -> DataFrame:
    return devices.where(F.col("role") == role).orderBy(seq)


def sites(devices: DataFrame, seq: str = "seq") -> DataFrame:
    """site and first, the place at which it is first named."""
    return devices.groupBy("site").agg(F.min(seq).alias("first"))


def sub_entity(site: Column, name: Column, role: Column, sub: Column | None = None) -> Column:
    """The id of a device, or of a part of it."""
    return F.concat_ws(":", site, name, role, *([sub] if sub is not None else []))


def tunnel_peers(devices: DataFrame, seq: str = "seq") -> DataFrame:
    """site, peer: the device that ends a site's tunnels, its first CE or else its first PE."""
    order = F.when(F.col("role") == "CE", 0).when(F.col("role") == "PE", 1)
    ends = devices.withColumn("__order", order).where("__order is not null")
    return first_by(ends, ["site"], ["__order", seq]).select("site", F.col("name").alias("peer"))


def slas(vrfs: Column, promised: dict[str, str]) -> Column:
    """What is promised for a device's VRFs, in the order of the promises."""
    return F.array_compact(F.array(*(F.when(F.array_contains(vrfs, v), sla) for v, sla in promised.items())))


def incident(incidents: DataFrame, wanted: DataFrame, key: str = "incident") -> DataFrame:
    """wanted (key) with status 200 and the incident's columns, or 404 where there is none."""
    there = incidents.withColumn("__there", F.lit(True))
    return wanted.join(there, key, "left").withColumn("status", F.when(F.col("__there"), 200).otherwise(404)).drop("__there")


def flows_within(flows: DataFrame, scope: DataFrame) -> DataFrame:
    """root, n_flows, vrfs: flows whose site or device lies in each root's blast radius.

    flows (flow_id, site, device, vrf); scope (root, sites, devices).  Two equi-joins, a flow counted once.
    """
    by_site = flows.join(scope.select("root", F.explode("sites").alias("site")), "site").select("root", "flow_id", "vrf")
    by_device = flows.join(scope.select("root", F.explode("devices").alias("device")), "device").select("root", "flow_id", "vrf")
    hit = by_site.unionByName(by_device).distinct()
    return hit.groupBy("root").agg(F.countDistinct("flow_id").alias("n_flows"), F.array_sort(F.collect_set("vrf")).alias("vrfs"))
