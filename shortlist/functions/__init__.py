"""Column-valued helpers shared by the operators. Nothing here touches rows on the driver."""
