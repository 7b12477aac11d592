"""Names, addresses and commands of the objects a role group owns.

All of them are NULL as soon as one part is NULL.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from muster.schema import DNS_SUFFIX, MASTER_RPC_PORT


def object_name(cluster: Column, role: Column, role_group: Column) -> Column:
    return F.concat(cluster, F.lit("-"), role, F.lit("-"), role_group)


def global_service(cluster: Column) -> Column:
    return F.concat(cluster, F.lit("-master"))


def service_fqdn(service: Column, namespace: Column) -> Column:
    return F.concat(service, F.lit("."), namespace, F.lit("." + DNS_SUFFIX))


def pod_fqdn(pod: Column, service: Column, namespace: Column) -> Column:
    return F.concat(pod, F.lit("."), service_fqdn(service, namespace))


def master_url(cluster: Column, namespace: Column) -> Column:
    fqdn = service_fqdn(global_service(cluster), namespace)
    return F.concat(F.lit("spark://"), fqdn, F.lit(f":{MASTER_RPC_PORT}"))


def start_command(role: Column, cluster: Column, namespace: Column) -> Column:
    """Command words as an array; workers are told where their master listens."""
    script = F.concat(F.lit("sbin/start-"), role, F.lit(".sh"))
    url = master_url(cluster, namespace)
    return F.when(role != "slave", F.array(script)).when(
        url.isNotNull(), F.array(script, url)
    )


def image(registry: Column, version: Column) -> Column:
    return F.concat(registry, F.lit(":"), version)
