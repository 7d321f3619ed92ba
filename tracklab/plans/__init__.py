"""Plan-level building blocks: segmented windows, quantiles and driver-table views."""
