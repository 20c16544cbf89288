"""DataFrame transformations for reconciling two overlapping event records on a grid."""
