"""DataFrame operators for planar layout data on an integer grid."""
