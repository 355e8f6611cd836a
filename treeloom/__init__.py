"""Document trees and CSS selectors over Spark DataFrames."""
