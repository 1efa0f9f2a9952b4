"""lacustra: raster analytics and change detection on Spark, and text operators in lacustra.llm."""

from lacustra.functions.indices import calculate_indices, calculate_normalized_difference, evi, nbr, ndbi, ndmi, ndvi, ndwi, savi
from lacustra.functions.stats import count_nonzero, max, mean, median, min, percentile, stats, std, sum, unique
from lacustra.operators.clustering import analyze_water_clusters, cluster_water_bodies, optimize_clustering
from lacustra.operators.features import augment_training_data, detect_changes_ml, extract_features, load_model, predict_raster, save_model, train_classifier
from lacustra.operators.neighbors import gradient, opening
from lacustra.operators.resample import resample
from lacustra.operators.views import changes, compare, compare_rgb, distribution_comparison, hist, plot, plot_rgb
from lacustra.operators.water import calculate_shape_metrics, get_water_bodies, water_change, water_stats
from lacustra.raster import Raster, from_numpy, validate_array, validate_bands
from lacustra.sources.pixels import read, write, write_table

__all__ = [
    "Raster", "analyze_water_clusters", "augment_training_data", "calculate_indices", "calculate_normalized_difference", "calculate_shape_metrics", "changes", "cluster_water_bodies", "compare", "compare_rgb",
    "count_nonzero", "detect_changes_ml", "distribution_comparison", "evi", "extract_features", "from_numpy", "get_water_bodies", "gradient", "hist", "load_model", "max", "mean", "median", "min", "nbr", "ndbi",
    "ndmi", "ndvi", "ndwi", "opening", "optimize_clustering", "percentile", "plot", "plot_rgb", "predict_raster", "read", "resample", "save_model", "savi", "stats", "std", "sum", "train_classifier", "unique",
    "validate_array", "validate_bands", "water_change", "water_stats", "write", "write_table",
]
