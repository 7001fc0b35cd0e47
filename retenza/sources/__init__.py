"""Sources, sinks and the driver-table adapter."""
