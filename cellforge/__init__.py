"""cellforge: mesh, particle and training-data analytics on Spark."""

from cellforge.api import Client, Dataset, Progress, compute, config, distance3, get_default_client, memory_dataset, open_dataset, set_default_client
from cellforge.plans.geometry import Block, Hierarchy, Level

__all__ = ["Block", "Client", "Dataset", "Hierarchy", "Level", "Progress", "compute", "config", "distance3", "get_default_client", "memory_dataset", "open_dataset", "set_default_client"]
